"""Command line: the collect / evaluate / bulletin / stats / lookup workflow over a store.

    python -m gleaner.cli collect  --landed DIR --store DIR [--config DIR] [--source NAME]
    python -m gleaner.cli evaluate --store DIR [--config DIR] [--rounds N] [--force]
    python -m gleaner.cli bulletin   --store DIR --out DIR [--config DIR]
    python -m gleaner.cli stats    --store DIR
    python -m gleaner.cli lookup   --store DIR --key KEY

``--landed`` holds one folder per source with the loaders' output: ``*.jsonl`` (one item
per line) or ``*.json`` (one JSON array or object per file; fields source, title, link,
creation_date, input), or a folder ``raw`` with one folder of JSON files per raw table,
from which the builder of the source's ``kind`` (setting; default: the folder's name)
makes the items. The store keeps ``items/version=N`` snapshots (every collect writes a
new one and never overwrites the one it read), an append-only evals table whose
``version=N`` parts each hold one evaluate run's rows, and ``quarantine/version=N`` with
the malformed records and rejected rows of each collect. A version counts once its commit
marker is there. ``--config`` holds ``base.toml`` and ``<source>/config.toml`` files; an
environment variable named like a key overrides it.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tomllib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import collect, bulletin, evaluate, scorers, serve
from gleaner.operators.ranking import rank_rows
from gleaner.operators.config import DEFAULTS, Config
from gleaner.session import build_session, configure
from gleaner.sources import builders, shaping, store
from gleaner.sources.registry import SourceRegistry

LANDED_SCHEMA = "source string, title string, link string, creation_date string, input string"
EVALS_SCHEMA = ("dedup_key string, seq bigint, round int, model string, prompt_hash string, "
                "eval_date timestamp_ntz, importance_score int, confidence_score int, summary string")
QUARANTINE_SCHEMA = "source_file string, config_path string, reason string, record string"
PROVIDERS = {"keyword": evaluate.scorer_provider(scorers.keyword_scorer())}
# Items of collect run N come before all earlier ones: ord = -N * ORD_BASE + position.
ORD_BASE = 1 << 40


# ------------------------------------------------------------------ configuration

def _as_text(v) -> str:
    return ",".join(str(x) for x in v) if isinstance(v, list) else str(v)


def load_config(config_dir: str | None, environ=os.environ) -> Config:
    """Settings files read on the driver (they are small): base plus one per source."""
    base, sources = {}, {}
    if config_dir:
        base_file = os.path.join(config_dir, "base.toml")
        if os.path.exists(base_file):
            with open(base_file, "rb") as f:
                base = {k: _as_text(v) for k, v in tomllib.load(f).items()}
        for name in sorted(os.listdir(config_dir)):
            path = os.path.join(config_dir, name, "config.toml")
            if os.path.exists(path):
                with open(path, "rb") as f:
                    sources[name] = {k: _as_text(v) for k, v in tomllib.load(f).items()}
    keys = set(base) | set(DEFAULTS) | {k for v in sources.values() for k in v}
    env = {k: environ[k] for k in keys if k in environ}
    return Config(base=base, sources=sources, env=env)


def read_evals(spark: SparkSession, store_dir: str) -> DataFrame:
    """The append-only evals table: every finished run's part together."""
    return store.read_versions(spark, f"{store_dir}/evals", EVALS_SCHEMA)


# ------------------------------------------------------------------ commands

def _folders(spark: SparkSession, path: str) -> dict[str, str]:
    fs, root = store.file_system(spark, path)
    return {s.getPath().getName(): s.getPath().toString()
            for s in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()) if s.isDirectory()}


def _landed(spark: SparkSession, name: str, folder: str, cfg: Config, now: datetime,
            bad: list[DataFrame]) -> DataFrame:
    """One source's items in arrival order (source_file, file_pos); malformed records are
    added to ``bad``."""
    inner = _folders(spark, folder)
    if "raw" in inner:
        kind = cfg.value("kind", name, name)
        tables = _folders(spark, inner["raw"])
        raw = {}
        for table, schema in builders.RAW.get(kind, {}).items():
            raw[table], broken = store.read_items_safe(spark, tables.get(table, f"{inner['raw']}/{table}"), schema)
            raw[table] = raw[table].drop("source_file", "file_pos")
            bad.append(_quarantined(broken, name))
        made = builders.build(kind, raw, cfg, now, name)
        newest = F.unix_micros(F.col("creation_date").cast("timestamp"))
        return made.withColumn("source_file", F.lit("raw")).withColumn("file_pos", -F.coalesce(newest, F.lit(0)))
    parts = []
    for pattern, multiline in (("*.jsonl", False), ("*.json", True)):
        good, broken = store.read_items_safe(spark, f"{folder}/{pattern}", LANDED_SCHEMA, multiline)
        bad.append(_quarantined(broken, name))
        parts.append(good.withColumn("creation_date_text", F.col("creation_date"))
                     .withColumn("creation_date", shaping.parse_item_date("creation_date")))
    return parts[0].unionByName(parts[1])


def _quarantined(broken: DataFrame, name: str) -> DataFrame:
    return broken.select("source_file", F.lit(name).alias("config_path"), F.lit("malformed").alias("reason"),
                         F.col(store.CORRUPT).alias("record"))


def cmd_collect(spark: SparkSession, landed: str, store_dir: str, only: str | None, cfg: Config,
                now: datetime) -> dict:
    reg, bad = SourceRegistry(), []
    for name, folder in _folders(spark, landed).items():
        reg.register(name, lambda spark, name=name, folder=folder: _landed(spark, name, folder, cfg, now, bad))
    # every source is read on its own: one that fails while running is skipped
    landed_rows, status = reg.union(spark, only=only, run=lambda df: df.checkpoint(eager=True))
    if "creation_date_text" not in landed_rows.columns:
        landed_rows = landed_rows.withColumn("creation_date_text", F.col("creation_date").cast("string"))
    if "source_file" not in landed_rows.columns:
        return {"status": status, "written": False, "reason": "no new data", "malformed": 0, "rejected": 0}
    dated = F.coalesce("creation_date_text", F.col("creation_date").cast("string"))
    checked = collect.validate_items(landed_rows.withColumn("_date", F.col("creation_date"))
                                     .withColumn("creation_date", dated))
    rejected = checked.where(F.col("reject_reason").isNotNull()).select(
        "source_file", "config_path", F.col("reject_reason").alias("reason"),
        F.to_json(F.struct("source", "title", "link", "creation_date", "input")).alias("record"))
    quarantine = rejected
    for part in bad:
        quarantine = quarantine.unionByName(part)
    quarantine = quarantine.checkpoint(eager=True)
    counted = {r["malformed"]: r["n"] for r in quarantine.groupBy((F.col("reason") == "malformed").alias("malformed"))
               .agg(F.count(F.lit(1)).alias("n")).collect()}
    outcome = {"status": status, "malformed": counted.get(True, 0), "rejected": counted.get(False, 0)}
    if outcome["malformed"] or outcome["rejected"]:
        store.write_version(quarantine, f"{store_dir}/quarantine")
    good = (checked.where(F.col("reject_reason").isNull()).withColumn("creation_date", F.col("_date"))
            .drop("reject_reason", "_date", "creation_date_text"))
    # first wins in the order of sources, files and positions, however Spark read them
    good = collect.with_dedup_key(good).withColumn("ord", F.struct("source_ord", "source_file", "file_pos", "link"))
    if good.isEmpty():
        return {**outcome, "written": False, "reason": "no new data"}
    version = store.claim_version(spark, f"{store_dir}/items")
    batch = collect.dedup_first_wins(good, "ord").drop("source_file", "file_pos")
    position = rank_rows(batch.select("dedup_key", "ord"), [F.col("ord").asc(), F.col("dedup_key").asc()],
                         rank_col="_pos").select("dedup_key", (F.col("_pos") - version * ORD_BASE).alias("_ord"))
    batch = batch.drop("ord").join(position, "dedup_key").withColumnRenamed("_ord", "ord")
    existing = store.read_latest(spark, f"{store_dir}/items")
    fields = collect.ITEM_FIELDS + ["config_path", "source_ord"]
    if existing is None:
        existing = batch.where("false").withColumns({c: F.lit(None).cast("timestamp_ntz")
                                                     for c in ("first_collected", "last_collected")})
    merged = collect.upsert_merge(existing, batch, now, fields)
    path = store.write_version(merged.drop("merge_part").sortWithinPartitions("creation_date"),
                               f"{store_dir}/items", version)
    # the counts come from what was written, not from running the merge again
    counts = spark.read.parquet(path).groupBy("merge_status").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["merge_status"]: r["n"] for r in counts}
    unique = n.get("new", 0) + n.get("updated", 0)
    return {**outcome, "written": True, "duplicates_removed": good.count() - unique, "new_items": n.get("new", 0),
            "updated_items": n.get("updated", 0), "total_items": unique + n.get("kept", 0)}


def _items_state(spark: SparkSession, store_dir: str) -> tuple[DataFrame, DataFrame]:
    items = store.read_latest(spark, f"{store_dir}/items")
    if items is None:
        raise SystemExit("empty store: run collect first")
    items = items.drop("merge_status")
    evals = read_evals(spark, store_dir)
    return evaluate.attach_state(items, evaluate.eval_state(evals)), evals


def cmd_evaluate(spark: SparkSession, store_dir: str, cfg: Config, rounds: int, force: bool,
                 now: datetime) -> dict:
    items = store.read_latest(spark, f"{store_dir}/items")
    if items is None:
        raise SystemExit("empty store: run collect first")
    evals = read_evals(spark, store_dir)
    recent = evaluate.recent_items(items.drop("input", "merge_status"), cfg, now, config_col="config_path")
    recent = recent.select("dedup_key", "ord", "title", "source", "config_path").checkpoint(eager=True)
    new = evaluate.new_evals(recent, evals, cfg, PROVIDERS, rounds, now, force=force, config_col="config_path",
                             inputs=items.select("ord", "input"))
    # append-only: this run's rows become a new part; earlier parts are never rewritten
    store.write_version(new.select(*[c.split()[0] for c in EVALS_SCHEMA.split(", ")]), f"{store_dir}/evals")
    return {"recent_items": recent.count(), "new_evals": new.count()}


def cmd_bulletin(spark: SparkSession, store_dir: str, out: str, cfg: Config, now: datetime) -> dict:
    state, evals = _items_state(spark, store_dir)
    ranked = bulletin.bulletin_ranked(state, cfg, now, config_col="config_path")
    grouped = bulletin.bulletin_by_source(ranked)
    with_summaries = bulletin.with_summary(grouped, evals)
    subject = bulletin.bulletin_subject(ranked, cfg.global_value("subject") or bulletin.SUBJECT).first()["subject"]
    if subject is None:
        return {"subject": None, "written": False}
    store.export_bulletin(with_summaries.select(
        "rank", "group_order", "source_rank", "group_source", "n_items", "dedup_key", "title", "link",
        F.coalesce("weighted_score", F.lit(0)).alias("score"),
        F.coalesce("median_confidence", F.lit(0)).alias("confidence"), "summary"), out)
    return {"subject": subject, "written": True, "path": out}


def cmd_stats(spark: SparkSession, store_dir: str) -> dict:
    state, _ = _items_state(spark, store_dir)
    return serve.score_bands(state).first().asDict()


def cmd_lookup(spark: SparkSession, store_dir: str, key: str) -> dict:
    items = store.read_latest(spark, f"{store_dir}/items")
    if items is None:
        raise SystemExit("empty store: run collect first")
    # both tables are filtered by the key before anything is aggregated
    wanted = items.drop("input", "merge_status").where(F.col("dedup_key") == key)
    history = read_evals(spark, store_dir).where(F.col("dedup_key") == key)
    row = evaluate.attach_state(wanted, evaluate.eval_state(history)).first()
    return {"found": False} if row is None else {"found": True, **{k: str(v) for k, v in row.asDict().items()}}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="gleaner")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("collect", "evaluate", "bulletin", "stats", "lookup"):
        p = sub.add_parser(name)
        p.add_argument("--store", required=True)
        p.add_argument("--config")
        p.add_argument("--now", help="clock as YYYY-MM-DDTHH:MM:SS (default: now, UTC)")
        if name == "collect":
            p.add_argument("--landed", required=True)
            p.add_argument("--source")
        if name == "evaluate":
            p.add_argument("--rounds", type=int)
            p.add_argument("--force", action="store_true")
        if name == "bulletin":
            p.add_argument("--out", required=True)
        if name == "lookup":
            p.add_argument("--key", required=True)
    a = ap.parse_args(argv)
    spark = configure(spark or build_session())
    now = (datetime.fromisoformat(a.now) if a.now
           else datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0))
    cfg = load_config(a.config)
    if a.cmd == "collect":
        return cmd_collect(spark, a.landed, a.store, a.source, cfg, now)
    if a.cmd == "evaluate":
        rounds = a.rounds or int(cfg.global_value("eval_rounds") or 1)
        return cmd_evaluate(spark, a.store, cfg, rounds, a.force, now)
    if a.cmd == "bulletin":
        return cmd_bulletin(spark, a.store, a.out, cfg, now)
    if a.cmd == "stats":
        return cmd_stats(spark, a.store)
    return cmd_lookup(spark, a.store, a.key)


def run() -> None:
    """Console entry point: print the command's result as one JSON line."""
    print(json.dumps(main(sys.argv[1:]), default=str))


if __name__ == "__main__":
    run()
