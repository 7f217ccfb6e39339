"""Evaluation stage (E1-E12): recency, candidates, prompts, scoring, response checks,
attempts, rounds and the per-item evaluation state."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.columns import add_days, sha256_hex
from gleaner.operators.ranking import rank_rows
from gleaner.operators.config import Config, parse_int, with_settings

# The "settled" rule that skips re-evaluation.
SETTLED_MIN_EVALS = 5        # strictly more evaluations than this
SETTLED_MIN_CONFIDENCE = 80  # strictly above
SETTLED_GOOD_SCORE = 80      # strictly above
SETTLED_BAD_SCORE = 20       # strictly below, and non-zero (0 counts as "no score")

REQUIRED_RESPONSE_KEYS = ["summary", "evaluation", "importance_score", "confidence_score"]
RESPONSE_SCHEMA = ("summary string, evaluation string, importance_score bigint, "
                   "confidence_score bigint, scratchpad string, followup string")

PROMPT_PARTS = ["prompt_header", "prompt_introduction", "prompt_container_pre", "@title",
                "@input", "prompt_container_post", "prompt_criteria", "prompt_instructions"]


def _ts(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


# ------------------------------------------------------------------ E1 recency

def recency_prefilter(cfg: Config, as_of: datetime, date_col: str = "creation_date",
                      config_col: str = "source") -> Column | None:
    """A filter on the raw columns that keeps a superset of the recent items, so it can
    reach the parquet scan (row-group skipping, partition pruning): dated items newer
    than the longest positive lookback, undated items, and the sources whose lookback
    disables the filter. None when the global lookback itself disables it."""
    default = int(cfg.defaults.get("lookback_days", "7"))
    if "lookback_days" in cfg.env:
        values, open_sources = [parse_int(cfg.env["lookback_days"], default)], []
    else:
        glob = parse_int(cfg.global_value("lookback_days"), default)
        per_source = {s: parse_int(v["lookback_days"], default)
                      for s, v in cfg.sources.items() if "lookback_days" in v}
        values = [glob] + list(per_source.values())
        open_sources = [s for s, v in per_source.items() if v <= 0]
        if glob <= 0:
            return None
    positive = [v for v in values if v > 0]
    if not positive:
        return None
    if max(positive) > 700_000:         # reaches before year 1: nothing to skip
        return None
    keep = (F.col(date_col) >= add_days(_ts(as_of), F.lit(-max(positive)))) | F.col(date_col).isNull()
    if open_sources:
        keep = keep | F.col(config_col).isin(*open_sources)
    return keep


def recent_items(items: DataFrame, cfg: Config, as_of: datetime,
                 date_col: str = "creation_date", config_col: str = "source") -> DataFrame:
    """Items created within their source's ``lookback_days`` of ``as_of``.
    ``lookback <= 0`` disables the filter; a missing or unparsable date counts as
    recent; the boundary is inclusive. A pushable superset filter goes first."""
    pre = recency_prefilter(cfg, as_of, date_col, config_col)
    if pre is not None:
        items = items.where(pre)
    s = with_settings(items, cfg, {"lookback_days": "int"}, config_col)
    return s.where(is_recent(as_of, date_col)).drop("lookback_days")


def is_recent(as_of: datetime, date_col: str = "creation_date") -> Column:
    """The exact recency test over an attached ``lookback_days`` column."""
    cutoff = add_days(_ts(as_of), -F.least(F.col("lookback_days"), F.lit(700_000)))
    return (F.col("lookback_days") <= 0) | F.col(date_col).isNull() | (F.col(date_col) >= cutoff)


# ------------------------------------------------------------------ E2/E3 candidates

def settled(num_evals: Column, confidence: Column, score: Column) -> Column:
    """The rule that marks an item as decided; a null or zero score/confidence never
    counts (they are falsy in the reference)."""
    high_conf = F.coalesce(confidence > SETTLED_MIN_CONFIDENCE, F.lit(False))
    good = F.coalesce(score > SETTLED_GOOD_SCORE, F.lit(False))
    bad = F.coalesce((score != 0) & (score < SETTLED_BAD_SCORE), F.lit(False))
    return (num_evals > SETTLED_MIN_EVALS) & high_conf & (good | bad)


def evaluation_status(num_evals: Column, confidence: Column, score: Column, round_num: int) -> Column:
    """queued / settled / done for one round."""
    queued = num_evals < round_num
    return (F.when(queued & settled(num_evals, confidence, score), F.lit("settled"))
             .when(queued, F.lit("queued")).otherwise(F.lit("done")))


def candidates(state: DataFrame, round_num: int, force: bool = False) -> DataFrame:
    """Items to evaluate in ``round_num``; ``force`` takes every given item."""
    if force:
        return state
    st = evaluation_status(F.col("num_evals"), F.col("median_confidence"),
                           F.col("weighted_score"), round_num)
    return state.where(st == "queued")


# ------------------------------------------------------------------ E4/E5 prompts

def assemble_prompt(items: DataFrame, cfg: Config, config_col: str = "source") -> DataFrame:
    """Eight parts joined by a blank line: header, introduction, container start,
    title, JSON input, container end, criteria, instructions (per-source parts)."""
    keys = {p: "string" for p in PROMPT_PARTS if not p.startswith("@")}
    s = with_settings(items, cfg, keys, config_col)
    parts = [F.col(p[1:]) if p.startswith("@") else F.col(p) for p in PROMPT_PARTS]
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(p)) for p, c in zip(PROMPT_PARTS, parts)]))
    return (s.withColumn("prompt", F.when(F.size(missing) == 0, F.concat_ws("\n\n", *parts)))
             .drop(*keys))


def with_prompt_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt_hash", sha256_hex("prompt"))


# ------------------------------------------------------------------ E6 scoring

Scorer = Callable[[DataFrame], DataFrame]


def score_items(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Apply a scorer: a ``DataFrame -> DataFrame`` adding ``response`` (STRUCT per
    ``RESPONSE_SCHEMA``) — built-in expressions, or ``pandas_scorer`` for Python.
    Scoring reads whole texts: its parallelism is that of the input's splits
    (``spark.sql.files.maxPartitionBytes``)."""
    return scorer(df)


def pandas_scorer(fn, extra_schema: str = RESPONSE_SCHEMA):
    """Wrap ``fn(pd.DataFrame) -> pd.DataFrame`` (returns the response columns) as a
    scorer run with ``mapInPandas`` (Arrow batches, one Python worker per task)."""
    def scorer(df: DataFrame) -> DataFrame:
        fields = [f.split()[0] for f in extra_schema.split(",")]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
                           + [extra_schema])

        def run(batches):
            for pdf in batches:
                out = fn(pdf)
                for name in fields:
                    pdf[name] = out[name] if name in out else None
                yield pdf
        scored = df.mapInPandas(run, schema)
        return scored.withColumn("response", F.struct(*fields)).drop(*fields)
    return scorer


# ------------------------------------------------------------------ E7/E8 validation

#: Bare NaN and infinities where a value stands, as a lenient JSON writer gives them.
_BARE_NUMBER = r"(?<=[:\[,])(\s*)-?(?:NaN|Infinity)(?=\s*[,}\]])"
#: Variant types of integers beyond 64 bits; shorter decimals come from 70.0 and the like.
_LONG_INTEGER = r"^DECIMAL\((19|[23]\d),0\)$"


def parsed_response(t: Column) -> Column:
    """The response text as a variant, null where it is no JSON. Of a repeated key the last
    one counts (a session setting, see ``session.RUNTIME_CONF``); bare NaN and infinities
    read as null."""
    parsed = F.try_parse_json(t)
    return F.coalesce(parsed, F.when(t.rlike("NaN|Infinity"), F.try_parse_json(F.regexp_replace(t, _BARE_NUMBER, "$1null"))))


def response_reason(text: str | Column) -> Column:
    """Why a model response text is rejected, or ``valid``. Scores must be JSON
    integers, of up to 38 digits (a quoted number, a float or a boolean is rejected); a
    key holding null, NaN or an infinity counts as present; of a repeated key the last one
    counts; a non-object counts as missing keys. One parse per text."""
    t = F.col(text) if isinstance(text, str) else text

    def judge(parsed: Column) -> Column:
        has_all = F.forall(F.array(*[F.try_variant_get(parsed, f"$.{k}", "variant") for k in REQUIRED_RESPONSE_KEYS]),
                           lambda v: v.isNotNull())

        def is_int(key: str) -> Column:
            kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
            written = F.get_json_object(t, f"$.{key}").rlike(r"^-?\d+$")
            return F.coalesce((kind == "BIGINT") | (kind.rlike(_LONG_INTEGER) & written), F.lit(False))

        return (F.when(parsed.isNull(), F.lit("bad_json"))
                 .when(~has_all, F.lit("missing_key"))
                 .when(~is_int("importance_score"), F.lit("non_int_importance"))
                 .when(~is_int("confidence_score"), F.lit("non_int_confidence"))
                 .otherwise(F.lit("valid")))

    return judge(parsed_response(t))


def response_scores(text: str | Column) -> Column:
    """Scores and summary of a valid response text. A score beyond the range of the store's
    integer columns is stored as the nearest value in range."""
    parsed = parsed_response(F.col(text) if isinstance(text, str) else text)

    def score(key: str) -> Column:
        value = F.try_variant_get(parsed, f"$.{key}", "decimal(38,0)")
        return F.greatest(F.lit(-(2 ** 31)), F.least(F.lit(2 ** 31 - 1), value)).cast("int").alias(key)

    return F.struct(score("importance_score"), score("confidence_score"),
                    F.try_variant_get(parsed, "$.summary", "string").alias("summary"))


def valid_response(col: str = "response") -> Column:
    """A scorer's response struct is usable when it exists and both scores are
    present (integers by the struct's type); otherwise the item is skipped."""
    r = F.col(col)
    return r.isNotNull() & r["importance_score"].isNotNull() & r["confidence_score"].isNotNull()


def first_valid_attempt(attempts: DataFrame, keys: list[str], max_attempts: int = 3,
                        text_col: str = "response_text") -> DataFrame:
    """Per ``keys`` group: the first valid response among attempts ``1..max_attempts``,
    else ``failed``. One aggregation (``min_by`` is map-side combinable)."""
    a = attempts.withColumn("_reason", response_reason(text_col))
    ok = (F.col("_reason") == "valid") & (F.col("attempt") <= max_attempts)
    never = F.lit(2 ** 31 - 1)
    g = a.groupBy(*keys).agg(
        F.min_by(F.col(text_col), F.coalesce(F.when(ok, F.col("attempt")), never)).alias("_text"),
        F.min(F.when(ok, F.col("attempt"))).alias("attempt_used"))
    done = F.col("attempt_used").isNotNull()
    return g.select(*keys, F.when(done, F.col("_text")).alias(text_col), "attempt_used",
                    F.when(done, F.lit("ok")).otherwise(F.lit("failed")).alias("status"))


# ------------------------------------------------------------------ E10-E12 state

def weighted_score_col(score: Column, confidence: Column) -> tuple[Column, Column]:
    """Aggregate parts: Σ score·(confidence+100) and Σ (confidence+100), in BIGINT."""
    w = confidence.cast("bigint") + 100
    return F.sum(score.cast("bigint") * w), F.sum(w)


def finish_weighted(sw: Column, w: Column) -> Column:
    """int(Σsw / Σw) truncated toward zero; 0 when the total weight is not positive."""
    return F.when(w > 0, (sw / w).cast("int")).otherwise(F.lit(0))


def eval_state(evals: DataFrame) -> DataFrame:
    """E10-E12 in one ``groupBy(dedup_key)``: num_evals, weighted_score,
    median_confidence (exact, interpolated, truncated) and the date of the last
    appended eval. All aggregates combine map-side; the exact median keeps a
    value->count map per key, bounded by the distinct confidence values."""
    sw, w = weighted_score_col(F.col("importance_score"), F.col("confidence_score"))
    return (evals.groupBy("dedup_key").agg(
        F.count(F.lit(1)).alias("num_evals"),
        sw.alias("_sw"), w.alias("_w"),
        F.median("confidence_score").alias("_med"),
        F.max_by("eval_date", "seq").alias("last_eval"))
        .select("dedup_key", "num_evals",
                finish_weighted(F.col("_sw"), F.col("_w")).alias("weighted_score"),
                F.col("_med").cast("int").alias("median_confidence"),
                "last_eval"))


# ------------------------------------------------------------------ E11 for huge groups

#: Values that a sketch keeps at its base level. Up to about this many evals it is exact;
#: beyond, its rank error is below RANK_ERROR.
SKETCH_K = 4096
RANK_ERROR = 0.002


def confidence_sketches(evals: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """E11 for groups of any size (a source, a model, all items): one mergeable quantile
    sketch of the confidences per ``by`` group, a few kilobytes however many evals and
    distinct values there are. Sketches are built map-side and merged in any order, so a
    group that holds most evals is no hot key. Store them with their round as part of
    ``by`` and fold them with ``merged_sketches`` when they are read."""
    return evals.where(F.col("confidence_score").isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_bigint(F.col("confidence_score").cast("bigint"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """Stored sketches folded to fewer groups (the rounds of a source to the source)."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def sketched_quantile(sketch: str | Column = "sketch", share: float = 0.5) -> Column:
    """The least confidence that at least ``share`` of the evals do not exceed."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(share))


def sketched_count(sketch: str | Column = "sketch") -> Column:
    return F.kll_sketch_get_n_bigint(sketch)


def attach_state(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with their evaluation state; never evaluated -> 0 evals, null scores."""
    return (items.join(state, "dedup_key", "left")
            .withColumn("num_evals", F.coalesce(F.col("num_evals"), F.lit(0).cast("bigint"))))


# ------------------------------------------------------------------ E9 rounds

# A provider answers prompts: ``(items with prompt, model, attempts) -> the same rows plus
# responses``, an array of response texts in the order of the attempts.
Provider = Callable[[DataFrame, str, int], DataFrame]


def scorer_provider(scorer: Scorer) -> Provider:
    """A provider out of a scorer: its response struct as JSON text, in one attempt."""
    def provider(df: DataFrame, model: str, attempts: int) -> DataFrame:
        # the generator keeps the optimiser from copying the score expressions, which read
        # whole texts, into every later use of the response
        scored = score_items(df, scorer).withColumn("response", F.explode(F.array("response")))
        text = F.when(F.col("response").isNotNull(), F.to_json("response"))
        return scored.withColumn("responses", F.array_compact(F.array(text))).drop("response")
    return provider


def answer(items: DataFrame, cfg: Config, providers: dict[str, Provider],
           config_col: str = "source") -> DataFrame:
    """E4-E8 for the given items: prompt and hash, the provider and model that the
    item's source is set to (``eval_provider``, ``eval_model``), at most
    ``eval_retries`` attempts, and the first valid response of each item. Items whose
    attempts all fail are left out. A provider name that is not known is an error."""
    return ask(items, cfg, providers, config_col).where(F.col("response_text").isNotNull())


def provider_pairs(cfg: Config) -> list[tuple[str, str]]:
    """The (provider, model) combinations that sources are set to, and that of sources
    without settings of their own."""
    def of(layer: dict[str, str]) -> tuple[str | None, str | None]:
        return tuple(cfg.env.get(k) or layer.get(k) or cfg.global_value(k) for k in ("eval_provider", "eval_model"))

    found = {of(layer) for layer in (*cfg.sources.values(), {})}
    return sorted((p, m) for p, m in found if p and m)


def ask(items: DataFrame, cfg: Config, providers: dict[str, Provider], config_col: str = "source") -> DataFrame:
    """As ``answer``, but items whose attempts all fail stay, with a null response."""
    asked = with_prompt_hash(assemble_prompt(items, cfg, config_col))
    asked = with_settings(asked, cfg, {"eval_provider": "string", "eval_model": "string",
                                       "eval_retries": "int"}, config_col)
    pairs = provider_pairs(cfg)
    unknown = sorted({p for p, _ in pairs} - set(providers))
    if unknown:
        raise ValueError(f"unknown eval_provider {unknown}; known: {sorted(providers)}")
    most = max(int(v) for v in [cfg.env.get("eval_retries") or cfg.global_value("eval_retries") or "3",
                                *(x["eval_retries"] for x in cfg.sources.values() if "eval_retries" in x)]
               if v.strip().isdigit())
    # one plan per combination that some source is set to; a single one needs no filter
    chosen = lambda n, m: asked if len(pairs) == 1 else asked.where(
        (F.col("eval_provider") == n) & (F.col("eval_model") == m))
    parts = [providers[n](chosen(n, m), m, most) for n, m in pairs]
    answered = parts[0]
    for part in parts[1:]:
        answered = answered.unionByName(part, allowMissingColumns=True)
    tried = F.slice("responses", 1, F.col("eval_retries"))
    good = F.filter(tried, lambda t: response_reason(t) == "valid")
    return (answered.withColumn("response_text", F.try_element_at(good, F.lit(1)))
            .withColumn("model", F.col("eval_model")).drop("responses", "eval_provider", "eval_retries", "eval_model"))


def tally(evals: DataFrame) -> DataFrame:
    """Per (key, confidence) the number of evals and their summed scores, with the last
    eval by append order: all that the evaluation state needs, and additive."""
    return evals.groupBy("dedup_key", "confidence_score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("importance_score").cast("bigint")).alias("scores"),
        F.max(F.struct("seq", "eval_date")).alias("last"))


def tallied_state(parts: DataFrame) -> DataFrame:
    """E10-E12 from tallies (one or more per key and confidence)."""
    weight = F.col("confidence_score").cast("bigint") + 100
    return (parts.groupBy("dedup_key").agg(
        F.sum("n").alias("num_evals"), F.sum(F.col("scores") * weight).alias("_sw"),
        F.sum(F.col("n") * weight).alias("_w"), F.percentile("confidence_score", F.lit(0.5), F.col("n")).alias("_med"),
        F.max("last").alias("_last"))
        .select("dedup_key", "num_evals", finish_weighted(F.col("_sw"), F.col("_w")).alias("weighted_score"),
                F.col("_med").cast("int").alias("median_confidence"), F.col("_last.eval_date").alias("last_eval")))


def new_evals(recent: DataFrame, evals: DataFrame, cfg: Config, providers: dict[str, Provider], rounds: int,
              as_of: datetime, force: bool = False, config_col: str = "source", inputs: DataFrame | None = None,
              persist=None) -> DataFrame:
    """Evaluate the ``recent`` items (E1 output: dedup_key, ord, title, source and
    ``input``; without ``input`` they take it from ``inputs`` (ord, input) when they are
    asked) for ``rounds`` rounds and return only the appended eval rows, with prompt hash
    and model. The state before the first round is a tally of the existing evals of
    these items; each round adds the tally of its own new rows, never the history again.
    The tally and each round's answers are persisted on their own (``persist(df, name)``,
    default ``DataFrame.checkpoint``); items without a valid response are skipped for
    that round only."""
    persist = persist or (lambda df, name: df.checkpoint(eager=True))
    keys = recent.select("dedup_key")
    tallies = persist(tally(evals).join(keys, "dedup_key", "left_semi"), "tally")
    base = evals.agg(F.max("seq")).first()[0] or 0    # one scalar: where this run's seq starts
    appended: list[DataFrame] = []
    for r in range(1, rounds + 1):
        state = attach_state(recent, tallied_state(tallies))
        todo = candidates(state, r, force).select(*recent.columns)
        if inputs is not None:
            todo = todo.join(inputs, "ord")
        # the answers are stored first: ranking reads its input twice, and a filter on the
        # response would be pushed below the scoring and run it again
        asked = persist(ask(todo, cfg, providers, config_col).select(
            "dedup_key", "ord", "model", "prompt_hash", "response_text"), f"answers_round_{r}")
        rows = asked.where(F.col("response_text").isNotNull()).withColumn("got", response_scores("response_text")).select(
            "dedup_key", "ord", F.lit(r).alias("round"), "model", "prompt_hash", _ts(as_of).alias("eval_date"),
            "got.importance_score", "got.confidence_score", "got.summary")
        # append order: arrival order within the round, after everything before it
        ranked = rank_rows(rows, [F.col("ord").asc(), F.col("dedup_key").asc()], rank_col="seq")
        appended.append(ranked.withColumn("seq", F.col("seq") + base).drop("ord"))
        base = appended[-1].agg(F.max("seq")).first()[0] or base
        tallies = tallies.unionByName(tally(appended[-1]))
    out = appended[0]
    for part in appended[1:]:
        out = out.unionByName(part)
    return out


def run_rounds(recent: DataFrame, evals: DataFrame, cfg: Config, providers: dict[str, Provider], rounds: int,
               as_of: datetime, **more) -> DataFrame:
    """E9 as a whole: the evals table with the new rows of ``rounds`` rounds appended
    (see ``new_evals``)."""
    new = new_evals(recent, evals, cfg, providers, rounds, as_of, **more)
    return evals.unionByName(new, allowMissingColumns=True)
