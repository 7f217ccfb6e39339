"""The command-line workflow end to end on landed JSON built from the documents table."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gleaner import cli
from gleaner.plans import bindings as b
from gleaner.session import scratch_path
from gleaner.sources import store

NOW = "2024-01-31T00:00:00"


def _land(spark, base, langs):
    """One folder per source holding a JSON array file, as the loaders print it."""
    d = b.table(spark, SF_SMALL, "documents").where(F.col("lang").isin(*langs)).orderBy("doc_id")
    for lang in langs:
        rows = [{"source": lang, "title": r["text"][:40], "link": f"https://example.org/{r['doc_id'] % 150}",
                 "creation_date": f"2024-01-{1 + r['doc_id'] % 30:02d}T00:00:00Z",
                 "input": {"doc_id": r["doc_id"], "text": r["text"]}}
                for r in d.where(F.col("lang") == lang).collect()]
        os.makedirs(f"{base}/{lang}", exist_ok=True)
        with open(f"{base}/{lang}/items.json", "w") as f:
            json.dump(rows, f, indent=2)
        yield lang, rows


def test_collect_evaluate_bulletin(spark, tmp_path):
    landed, st, out = scratch_path(spark, "landed"), scratch_path(spark, "store"), scratch_path(spark, "bulletin")
    landed_rows = dict(_land(spark, landed, ["de", "fr"]))
    cfg_dir = tmp_path / "cfg"
    (cfg_dir / "fr").mkdir(parents=True)
    (cfg_dir / "base.toml").write_text('lookback_days = 10\nmin_email_score = 0\neval_rounds = 1\n')
    (cfg_dir / "fr" / "config.toml").write_text('min_email_score = 101\n')

    first = cli.main(["collect", "--landed", landed, "--store", st, "--now", NOW], spark)
    n_keys = len({(s, r["link"]) for s, rows in landed_rows.items() for r in rows})
    assert first["written"] and first["total_items"] == n_keys
    again = cli.main(["collect", "--landed", landed, "--store", st, "--now", NOW], spark)
    assert again["updated_items"] == n_keys and again["new_items"] == 0
    assert store.latest_version(spark, f"{st}/items") == 2

    ev = cli.main(["evaluate", "--store", st, "--config", str(cfg_dir), "--now", NOW], spark)
    assert ev["new_evals"] == ev["recent_items"] > 0
    ev2 = cli.main(["evaluate", "--store", st, "--config", str(cfg_dir), "--now", NOW], spark)
    assert ev2["new_evals"] == 0          # one round: everything recent already has an eval

    dg = cli.main(["bulletin", "--store", st, "--out", out, "--config", str(cfg_dir), "--now", NOW], spark)
    assert dg["written"] and dg["subject"].endswith("items in your weekly bulletin")
    rows = spark.read.json(out).collect()
    assert {r["group_source"] for r in rows} == {"de"}       # fr threshold 101 keeps nothing
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))

    stats = cli.main(["stats", "--store", st], spark)
    assert stats["total_items"] == n_keys and stats["sources"] == "de,fr"
    key = rows[0]["dedup_key"]
    assert cli.main(["lookup", "--store", st, "--key", key], spark)["found"]
    assert not cli.main(["lookup", "--store", st, "--key", "nope"], spark)["found"]


def test_collect_empty_batch_and_unknown_source(spark):
    landed, st = scratch_path(spark, "landed-empty"), scratch_path(spark, "store-empty")
    os.makedirs(f"{landed}/feeds", exist_ok=True)
    with open(f"{landed}/feeds/items.json", "w") as f:
        json.dump([], f)
    res = cli.main(["collect", "--landed", landed, "--store", st, "--now", NOW], spark)
    assert not res["written"] and store.latest_version(spark, f"{st}/items") == 0
    res = cli.main(["collect", "--landed", landed, "--store", st, "--source", "nope", "--now", NOW], spark)
    assert not res["written"] and res["status"][0]["known"] == ["feeds"]


def test_repeated_evaluate_runs_keep_seq_increasing(spark):
    landed, st = scratch_path(spark, "landed-seq"), scratch_path(spark, "store-seq")
    list(_land(spark, landed, ["es"]))
    cli.main(["collect", "--landed", landed, "--store", st, "--now", NOW], spark)
    for _ in range(2):
        cli.main(["evaluate", "--store", st, "--rounds", "1", "--force", "--now", NOW], spark)
    ev = cli.read_evals(spark, st)
    assert ev.select("seq").distinct().count() == ev.count()
    per_item = ev.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    assert per_item == 2


def _item(link, title):
    return {"source": "s", "title": title, "link": link, "creation_date": "2024-01-30T00:00:00Z", "input": {"t": title}}


def test_upsert_order_and_collection_dates(spark):
    landed1, landed2 = scratch_path(spark, "l1"), scratch_path(spark, "l2")
    st = scratch_path(spark, "store-order")
    for base, rows in [(landed1, [_item("A", "old"), _item("C", "c")]), (landed2, [_item("A", "new"), _item("B", "b")])]:
        os.makedirs(f"{base}/feeds", exist_ok=True)
        with open(f"{base}/feeds/items.json", "w") as f:
            json.dump(rows, f)
    cli.main(["collect", "--landed", landed1, "--store", st, "--now", "2024-01-30T00:00:00"], spark)
    res = cli.main(["collect", "--landed", landed2, "--store", st, "--now", NOW], spark)
    assert (res["new_items"], res["updated_items"], res["total_items"]) == (1, 1, 3)
    items = store.read_latest(spark, f"{st}/items").orderBy("ord").collect()
    assert [(r["link"], r["title"]) for r in items] == [("A", "new"), ("B", "b"), ("C", "c")]
    first = {r["link"]: (str(r["first_collected"]), str(r["last_collected"])) for r in items}
    assert first["A"] == ("2024-01-30 00:00:00", "2024-01-31 00:00:00")
    assert first["B"] == ("2024-01-31 00:00:00", "2024-01-31 00:00:00")
    assert first["C"] == ("2024-01-30 00:00:00", "2024-01-30 00:00:00")


def _write(base, name, text):
    os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
    with open(f"{base}/{name}", "w") as f:
        f.write(text)


def test_first_wins_by_file_order_and_rejects_are_kept(spark):
    landed, st = scratch_path(spark, "l3"), scratch_path(spark, "store-files")
    _write(landed, "feeds/a.json", json.dumps([_item("A", "first")]))
    _write(landed, "feeds/b.json", json.dumps([_item("A", "second " + "x" * 50_000), _item("B", "b")]))
    _write(landed, "feeds/c.json", "[" + json.dumps(_item("C", "c")) + ", {broken")
    _write(landed, "feeds/d.jsonl", json.dumps(_item("D", "d")) + "\n{oops\n" + json.dumps({**_item("E", "e"), "link": None}) + "\n")
    res = cli.main(["collect", "--landed", landed, "--store", st, "--now", NOW], spark)
    assert (res["new_items"], res["duplicates_removed"], res["malformed"], res["rejected"]) == (3, 1, 2, 1)
    items = {r["link"]: r["title"] for r in store.read_latest(spark, f"{st}/items").collect()}
    assert items == {"A": "first", "B": items["B"], "D": "d"}
    q = store.read_versions(spark, f"{st}/quarantine", cli.QUARANTINE_SCHEMA).collect()
    assert sorted((os.path.basename(r["source_file"]), r["reason"]) for r in q) == [
        ("c.json", "malformed"), ("d.jsonl", "malformed"), ("d.jsonl", "missing_link")]


def test_half_written_version_is_ignored_and_numbers_are_claimed(spark):
    landed, st = scratch_path(spark, "l4"), scratch_path(spark, "store-half")
    _write(landed, "feeds/a.json", json.dumps([_item("A", "a")]))
    cli.main(["collect", "--landed", landed, "--store", st, "--now", NOW], spark)
    _write(st, "items/version=2/part-0.parquet", "half")
    assert store.latest_version(spark, f"{st}/items") == 1
    assert store.claim_version(spark, f"{st}/items") == 2 and store.claim_version(spark, f"{st}/items") == 3
    res = cli.main(["collect", "--landed", landed, "--store", st, "--now", NOW], spark)
    assert res["updated_items"] == 1 and store.latest_version(spark, f"{st}/items") == 4


def test_collect_from_raw_tables(spark, tmp_path):
    landed, st = scratch_path(spark, "l5"), scratch_path(spark, "store-raw")
    post = {"id": "1", "name": "thing", "url": "https://x.example/1", "votesCount": 300, "createdAt": "2024-01-30T00:00:00Z"}
    _write(landed, "launches/raw/posts/p.json", json.dumps(post) + "\n" + json.dumps({**post, "id": "2", "url": "u2", "votesCount": 3}))
    cfg = tmp_path / "cfg"
    _write(str(cfg), "launches/config.toml", 'kind = "posts"\nmin_votes = 100\n')
    res = cli.main(["collect", "--landed", landed, "--store", st, "--config", str(cfg), "--now", NOW], spark)
    assert res["new_items"] == 1
    row = store.read_latest(spark, f"{st}/items").first()
    assert (row["title"], row["link"], row["config_path"]) == ("thing", "https://x.example/1", "launches")
    _write(str(cfg), "launches/config.toml", 'kind = "nope"\n')
    res = cli.main(["collect", "--landed", landed, "--store", st, "--config", str(cfg), "--now", NOW], spark)
    assert res["status"][0]["status"] == "failed" and not res["written"]
