"""Configuration as a dimension.

The reference keeps settings in a base file, one file per source and the process
environment, resolved per key as environment > source > base > default. Here the
layers are a driver-side object (reading settings files is driver work); Spark sees
them as a long table ``(layer, source, key, value)`` and, per item, as a broadcast
join of the per-source overrides plus literals for the global layers. The config is
bounded by (sources x keys), independent of data volume, which is what makes the
broadcast safe.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.columns import as_double, as_int

LAYER_ORDER = ["env", "source", "base", "default"]

# Library defaults for the settings the pipeline reads.
DEFAULTS = {
    "lookback_days": "7",
    "eval_rounds": "1",
    "min_email_score": "70",
    "eval_provider": "keyword",
    "eval_model": "keyword-v1",
    "eval_retries": "3",
    "prompt_header": "You screen incoming items for a reader with limited time.",
    "prompt_introduction": "Read the item below and judge how worth reading it is.",
    "prompt_container_pre": "<item>",
    "prompt_container_post": "</item>",
    "prompt_criteria": "Prefer original, well-argued and clearly written material.",
    "prompt_instructions": ("Answer in JSON with keys summary, evaluation, importance_score "
                            "and confidence_score (integers 0-100)."),
}


def parse_int(text: str | None, default: int) -> int:
    """A setting as the column expression ``as_int`` reads it."""
    number = int(text) if re.fullmatch(r"\s*[+-]?[0-9]+\s*", text or "", re.ASCII) else default
    return number if -2 ** 31 <= number < 2 ** 31 else default

CONFIG_SCHEMA = "layer string, source string, key string, value string"


@dataclass
class Config:
    base: dict[str, str] = field(default_factory=dict)
    sources: dict[str, dict[str, str]] = field(default_factory=dict)
    env: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=lambda: dict(DEFAULTS))

    def keys(self) -> list[str]:
        ks = set(self.base) | set(self.env) | set(self.defaults)
        for vals in self.sources.values():
            ks |= set(vals)
        return sorted(ks)

    def global_value(self, key: str) -> str | None:
        for layer in (self.env, self.base, self.defaults):
            if key in layer:
                return layer[key]
        return None

    def value(self, key: str, source: str, default: str | None = None) -> str | None:
        """The winning value of a key for one source."""
        for layer in (self.env, self.sources.get(source, {}), self.base, self.defaults):
            if key in layer:
                return layer[key]
        return default

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [("env", None, k, v) for k, v in self.env.items()]
        rows += [("source", s, k, v) for s, vals in self.sources.items() for k, v in vals.items()]
        rows += [("base", None, k, v) for k, v in self.base.items()]
        rows += [("default", None, k, v) for k, v in self.defaults.items()]
        return spark.createDataFrame(rows, CONFIG_SCHEMA)


def with_settings(df: DataFrame, cfg: Config, keys: dict[str, str],
                  source_col: str = "source") -> DataFrame:
    """Attach resolved settings as columns, typed as ``keys[k]`` in {"int","double","string"}.

    Env overrides a source value, which overrides base and default (env > source >
    base > default): an env value is a literal that wins outright, otherwise the
    per-source override (broadcast join) is coalesced with the base/default literal.
    A key defined in no layer raises ``KeyError`` when the plan is built; a key defined
    only for some sources is null for the others (their items are then skipped)."""
    spark = df.sparkSession
    names = list(keys)
    undefined = [k for k in names if cfg.global_value(k) is None
                 and not any(k in vals for vals in cfg.sources.values())]
    if undefined:   # defined in no layer and without a default: a configuration error
        raise KeyError(f"configuration keys not found and no default provided: {undefined}")
    rows = [(s, *[vals.get(k) for k in names]) for s, vals in cfg.sources.items()]
    schema = ", ".join([f"`{source_col}` string"] + [f"`_s_{k}` string" for k in names])
    overrides = spark.createDataFrame(rows, schema)
    out = df.join(F.broadcast(overrides), on=source_col, how="left")
    for k, typ in keys.items():
        if k in cfg.env:
            raw = F.lit(cfg.env[k])
        else:
            fallback = cfg.global_value(k)
            raw = F.coalesce(F.col(f"_s_{k}"), F.lit(fallback).cast("string"))
        default = cfg.defaults.get(k)
        if typ == "int":
            v = as_int(raw, int(default) if default is not None else 0)
        elif typ == "double":
            v = as_double(raw, float(default) if default is not None else 0.0)
        else:
            v = raw
        out = out.withColumn(k, v)
    return out.drop(*[f"_s_{k}" for k in names])


def resolve_config(cfg: Config, sources: DataFrame) -> DataFrame:
    """For every (source, key) the winning value and its layer.

    ``sources`` is a one-column frame of source names derived from the data. Global
    keys are spread over each source by a generator over the bounded key list (not a
    cartesian join); source-layer rows join on (source, key)."""
    spark = sources.sparkSession
    cfg_frame = cfg.to_frame(spark)
    global_keys = sorted(set(cfg.env) | set(cfg.base) | set(cfg.defaults))
    srcs = sources.select("source").distinct()
    src_rows = (cfg_frame.where(F.col("layer") == "source")
                .select("source", "key", F.col("value").alias("v_source")))
    grid = (srcs.select("source", F.explode(F.array(*[F.lit(k) for k in global_keys])).alias("key"))
            .unionByName(src_rows.join(srcs, "source", "left_semi").select("source", "key"))
            .distinct())
    out = grid.join(F.broadcast(src_rows), ["source", "key"], "left")
    for layer in ("env", "base", "default"):
        lv = (cfg_frame.where(F.col("layer") == layer)
              .select("key", F.col("value").alias(f"v_{layer}")))
        out = out.join(F.broadcast(lv), "key", "left")
    value = F.coalesce(*[F.col(f"v_{layer}") for layer in LAYER_ORDER])
    layer = F.coalesce(*[F.when(F.col(f"v_{layer}").isNotNull(), F.lit(layer)) for layer in LAYER_ORDER])
    return out.select("source", "key", value.alias("value"), layer.alias("layer"))

