"""Hand-computed cases from FIXTURES.md: branches the driver tables do not reach."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions.columns import as_int, as_list, dedup_key, word_count
from gleaner.functions.html import extract_main_content
from gleaner.operators import analysis, collect, bulletin, evaluate, serve
from gleaner.operators.config import Config, resolve_config, with_settings
from gleaner.sources import shaping

AS_OF = datetime(2024, 1, 31)
EVAL_SCHEMA = "dedup_key string, seq bigint, importance_score int, confidence_score int, eval_date timestamp_ntz"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_dedup_key_matches_md5_of_utf8(spark):
    df = spark.createDataFrame([("feeds", "é")], "source string, link string")
    got = df.select(dedup_key().alias("k")).first()["k"]
    assert got == hashlib.md5("feeds|é".encode()).hexdigest()


@pytest.mark.parametrize("evals,score,conf", [
    ([(80, 90), (60, 40)], 71, 65),
    ([(50, 1), (50, 2)], 50, 1),
    ([(100, 0)], 100, 0),
    ([(70, -100)], 0, -100),
])
def test_weighted_score_and_median(spark, evals, score, conf):
    data = [("k", i, s, c, datetime(2024, 1, 1)) for i, (s, c) in enumerate(evals)]
    st = evaluate.eval_state(spark.createDataFrame(data, EVAL_SCHEMA)).first()
    assert (st["weighted_score"], st["median_confidence"], st["num_evals"]) == (score, conf, len(evals))


def test_never_evaluated_item_has_initial_state(spark):
    items = spark.createDataFrame([("k",)], "dedup_key string")
    st = evaluate.attach_state(items, evaluate.eval_state(spark.createDataFrame([], EVAL_SCHEMA))).first()
    assert (st["num_evals"], st["weighted_score"], st["median_confidence"], st["last_eval"]) == (0, None, None, None)


@pytest.mark.parametrize("text,lookback,recent", [
    ("2024-01-24T00:00:00Z", "7", True),
    ("2024-01-23T23:59:59Z", "7", False),
    ("2024-01-23T23:30:00-01:00", "7", True),
    (None, "7", True), ("", "7", True), ("garbage", "7", True), ("2024-13-32T19:16:33+00:00", "7", True),
    ("2020-01-01T00:00:00Z", "0", True), ("2020-01-01T00:00:00Z", "-1", True),
    ("2024-01-25T00:00:00", "7", True),
])
def test_recency(spark, text, lookback, recent):
    cfg = Config(base={"lookback_days": lookback})
    df = spark.createDataFrame([("s", text)], "source string, raw string").withColumn(
        "creation_date", shaping.parse_item_date("raw"))
    assert (evaluate.recent_items(df, cfg, AS_OF).count() == 1) is recent


@pytest.mark.parametrize("n,conf,score,status", [
    (0, None, None, "queued"), (6, 81, 81, "settled"), (6, 81, 19, "settled"), (6, 81, 0, "queued"),
    (6, 80, 90, "queued"), (5, 99, 99, "queued"), (6, 99, 80, "queued"), (6, 99, 20, "queued"),
    (8, 10, 50, "done"),
])
def test_needs_evaluation(spark, n, conf, score, status):
    df = spark.createDataFrame([(n, conf, score)], "n int, c int, s int")
    got = df.select(evaluate.evaluation_status(F.col("n"), F.col("c"), F.col("s"), 8).alias("x")).first()["x"]
    assert got == status


S = '"summary": "s", "evaluation": "e"'


@pytest.mark.parametrize("text,reason", [
    ("{%s, \"importance_score\": 70, \"confidence_score\": 90}" % S, "valid"),
    ("{%s, \"importance_score\": \"70\", \"confidence_score\": 90}" % S, "non_int_importance"),
    ("{%s, \"importance_score\": 70.0, \"confidence_score\": 90}" % S, "non_int_importance"),
    ("{%s, \"importance_score\": true, \"confidence_score\": 90}" % S, "non_int_importance"),
    ("{%s, \"importance_score\": 70, \"confidence_score\": null}" % S, "non_int_confidence"),
    ('{"evaluation": "e", "importance_score": 70, "confidence_score": 90}', "missing_key"),
    ("[1]", "missing_key"),
    ("{bad", "bad_json"),
    ("{%s, \"importance_score\": 250, \"confidence_score\": 90}" % S, "valid"),
])
def test_response_validation(spark, text, reason):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(evaluate.response_reason("t").alias("r")).first()["r"] == reason


def _resp(score):
    return "{%s, \"importance_score\": %d, \"confidence_score\": 50}" % (S, score)


def test_first_valid_attempt(spark):
    data = [("a", 1, "{bad"), ("a", 2, _resp(60)), ("a", 3, _resp(70)),
            ("b", 1, "{bad"), ("b", 2, "{bad"), ("b", 3, "[1]"), ("b", 4, _resp(10))]
    df = spark.createDataFrame(data, "k string, attempt int, response_text string")
    got = {r["k"]: (r["status"], r["attempt_used"]) for r in evaluate.first_valid_attempt(df, ["k"], 3).collect()}
    assert got == {"a": ("ok", 2), "b": ("failed", None)}


ITEM = "ord bigint, source string, title string, link string, creation_date timestamp_ntz, input string"


def test_dedup_first_wins(spark):
    landed = collect.with_dedup_key(spark.createDataFrame(
        [(1, "s", "A1", "a", None, "{}"), (2, "s", "B", "b", None, "{}"), (3, "s", "A2", "a", None, "{}")], ITEM))
    got = sorted(rows(collect.dedup_first_wins(landed), "title"))
    assert got == [("A1",), ("B",)]


def test_upsert_merge(spark):
    d0, d1 = datetime(2024, 1, 1), datetime(2024, 1, 10)
    existing = collect.with_dedup_key(spark.createDataFrame(
        [(1, "s", "old", "a", None, '{"x": 1}'), (2, "s", "C", "c", None, "{}")], ITEM)).withColumn(
        "first_collected", F.lit(d0).cast("timestamp_ntz")).withColumn("last_collected", F.lit(d0).cast("timestamp_ntz"))
    batch = collect.with_dedup_key(spark.createDataFrame(
        [(1, "s", "new", "a", None, None), (2, "s", "B", "b", None, "{}")], ITEM))
    merged = collect.upsert_merge(existing, batch, d1)
    got = {r["title"]: (r["first_collected"], r["last_collected"], r["merge_status"], r["input"])
           for r in merged.collect()}
    assert got["new"] == (d0, d1, "updated", None)      # incoming null overwrites
    assert got["B"] == (d1, d1, "new", "{}")
    assert got["C"] == (d0, d0, "kept", "{}")
    counts = collect.collect_counts(batch, batch, merged).first()
    assert (counts["new_items"], counts["updated_items"], counts["total_items"]) == (1, 1, 3)


def test_config_precedence_and_typing(spark):
    cfg = Config(env={"eval_model": "from-env"}, base={"lookback_days": " 7 ", "k": "base"},
                 sources={"s1": {"k": "src", "lookback_days": "llama3.2"}})
    srcs = spark.createDataFrame([("s1",), ("s2",)], "source string")
    res = {(r["source"], r["key"]): (r["value"], r["layer"]) for r in resolve_config(cfg, srcs).collect()}
    assert res[("s1", "k")] == ("src", "source")
    assert res[("s2", "k")] == ("base", "base")
    assert res[("s1", "eval_model")] == ("from-env", "env")
    assert res[("s2", "min_email_score")] == ("70", "default")
    typed = {r["source"]: r["lookback_days"] for r in with_settings(srcs, cfg, {"lookback_days": "int"}).collect()}
    assert typed == {"s1": 7, "s2": 7}   # unparsable -> default 7; " 7 " -> 7
    df = spark.createDataFrame([("a, b,,c ",)], "v string")
    assert df.select(as_list("v").alias("l")).first()["l"] == ["a", "b", "c"]
    assert df.select(as_int(F.lit("7"), -1).alias("i")).first()["i"] == 7


@pytest.mark.parametrize("html,text", [
    ("<body><nav>n</nav><article><p>a</p><p>b</p></article>z</body>", "a b"),
    ("<body><main>m</main>z</body>", "m"),
    ('<body><div role="main">r</div>z</body>', "r"),
    ('<body><div class="post-content">c</div>z</body>', "c"),
    ('<body><div class="main-content">c</div><main>m</main></body>', "m"),
    ("<body><script>x</script><aside>y</aside>t</body>", "t"),
    ('<body><div class="content"><p>a</p><p>b</p></div>z</body>', "a b"),
    ("<body><article></article>z</body>", ""),
    ("plain", "plain"),
])
def test_extraction_ladder(spark, html, text):
    df = spark.createDataFrame([(html,)], "html string")
    assert extract_main_content(df, "html", "t").first()["t"] == text


def test_word_count(spark):
    df = spark.createDataFrame([("Été 12 foo_bar d'un",), ("",)], "t string")
    assert [r["n"] for r in df.select(word_count("t").alias("n")).collect()] == [5, 0]


def test_short_content_fallback(spark):
    w = lambda n: " ".join(["w"] * n)
    feed = spark.createDataFrame([("u1", f"<p>{w(49)}</p>"), ("u2", f"<p>{w(49)}</p>"), ("u3", f"<p>{w(50)}</p>")],
                                 "url string, html string")
    pages = spark.createDataFrame([("u1", f"<article>{w(50)}</article>"), ("u2", f"<article>{w(49)}</article>"),
                                   ("u3", f"<article>{w(90)}</article>")], "url string, html string")
    got = dict(rows(shaping.short_content_fallback(feed, pages, 50), "url", "content_from"))
    assert got == {"u1": "full", "u2": "short", "u3": "short"}


def test_flatten_rich_text(spark):
    trees = ['{"type":"doc","content":[{"type":"mention","attrs":{"label":"@ann"}},{"type":"text","text":" hi"}]}',
             '{"type":"image","attrs":{"alt":"cat"}}', '{"type":"image","attrs":{"alt":null}}',
             '{"type":"image"}',
             '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a"}]},'
             '{"type":"paragraph","content":[{"type":"text","text":"b"}]}]}']
    df = spark.createDataFrame([(t,) for t in trees], "t string")
    got = [r["x"] for r in df.select(shaping.flatten_rich_text("t").alias("x")).collect()]
    assert got == ["@ann hi", "cat", "[image]", "[image]", "ab"]


def test_min_length(spark):
    df = spark.createDataFrame([("x" * 500,), ("x" * 501,)], "content string")
    assert [len(r["content"]) for r in shaping.long_comments(df).collect()] == [501]


def test_attach_comments(spark):
    projects = spark.createDataFrame([("p",), ("q",)], "slug string")
    comments = spark.createDataFrame([("p", 2, 2, "N", "c2"), ("p", 1, 1, "N", "c1")],
                                     "slug string, created_at int, seq int, full_name string, content string")
    got = sorted(rows(shaping.attach_comments(projects, comments), "slug", "comment_index", "comment"),
                 key=lambda r: (r[0], r[1] or 0))
    assert got == [("p", 1, "N says: c1"), ("p", 2, "N says: c2"), ("q", None, None)]


def test_combine_repos(spark):
    lists = spark.createDataFrame([(0, 0, "x", "x1"), (0, 1, "y", "y1"), (1, 0, "y", "y2"), (1, 1, "z", "z2")],
                                  "list_ord int, pos int, full_name string, v string")
    starred = spark.createDataFrame([("z",)], "full_name string")
    got = rows(shaping.combine_repos(shaping.drop_starred(lists, starred), 30).orderBy("rank"), "full_name", "v")
    assert got == [("x", "x1"), ("y", "y2")]


def test_readme_decode(spark):
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "full_name string")
    readmes = spark.createDataFrame([("a", "aGVs\nbG8="), ("b", "//4=")], "full_name string, content string")
    got = dict(rows(shaping.attach_readme(repos, readmes), "full_name", "readme_content"))
    assert got == {"a": "hello", "b": None, "c": None}


def test_bulletin_groups_and_summaries(spark):
    state = spark.createDataFrame(
        [("p", 1, "s1", 90), ("q", 2, "s2", 80), ("r", 3, "s1", 70), ("t", 4, "s2", 60)],
        "dedup_key string, ord bigint, source string, weighted_score int").withColumn(
        "creation_date", F.lit(None).cast("timestamp_ntz")).withColumn(
        "median_confidence", F.lit(None).cast("int")).withColumn("title", F.col("dedup_key")).withColumn(
        "link", F.lit(None).cast("string"))
    cfg = Config(base={"min_email_score": "0", "lookback_days": "0"})
    top = bulletin.bulletin_top(state, cfg, AS_OF, 3)
    assert rows(top.orderBy("rank"), "dedup_key", "confidence") == [("p", 0), ("q", 0), ("r", 0)]
    ranked = bulletin.bulletin_ranked(state, cfg, AS_OF)
    groups = rows(bulletin.bulletin_by_source(ranked).orderBy("group_order", "source_rank"),
                  "group_source", "dedup_key", "n_items")
    assert groups == [("s1", "p", 2), ("s1", "r", 2), ("s2", "q", 2), ("s2", "t", 2)]
    evals = spark.createDataFrame([("p", 1, ""), ("p", 2, None), ("p", 3, "x")], "dedup_key string, seq bigint, summary string")
    summ = dict(rows(bulletin.with_summary(state.select("dedup_key"), evals), "dedup_key", "summary"))
    assert summ["p"] == "x" and summ["q"] == bulletin.NO_SUMMARY
    assert bulletin.bulletin_subject(ranked).first()["subject"] == "4 items in your weekly bulletin"
    assert bulletin.bulletin_subject(ranked.where("false")).first()["subject"] is None


def test_score_bands_and_search(spark):
    store = spark.createDataFrame([(70, "A% one"), (69, "b"), (30, "ax"), (29, "c"), (None, "a%")],
                                  "weighted_score int, title string").withColumn("source", F.lit("s"))
    b = serve.score_bands(store).first()
    assert (b["high"], b["medium"], b["low"], b["total_items"]) == (1, 2, 2, 5)
    assert sorted(r["title"] for r in serve.search_items(store, term="A%").collect()) == ["A% one", "a%"]


def test_score_distribution_labels_and_limit(spark):
    items = [(f"k{i}", i, "s", "t" * (50 if i == 1 else 51), i) for i in range(51)]
    store = spark.createDataFrame(items, "dedup_key string, ord bigint, source string, title string, weighted_score int")
    evals = spark.createDataFrame([(k, 1, 10) for k, *_ in items], "dedup_key string, seq bigint, importance_score int")
    out = analysis.score_distribution(store, evals, 50)
    labels = dict(rows(out, "dedup_key", "label"))
    assert "k0" not in labels and len(labels) == 50
    assert labels["k1"] == "s: " + "t" * 50 and labels["k2"] == "s: " + "t" * 50 + "..."


@pytest.mark.parametrize("html,text", [
    ("<p>a&amp;lt;b &middot; c&copy;</p>", "a&lt;b · c©"),
    ("<style>p{}</style><script>var t='</p>';</script><!-- x --><p>kept</p>", "kept"),
    ("<p>one\n\n  two</p><br><p>three</p>", "one two three"),
    ("it&#8217;s caf&eacute; &#x41;&hellip; &unknown; &amp;eacute;", "it\u2019s caf\u00e9 A\u2026 &unknown; &eacute;"),
    ('<a title="x>y">link</a> a < b', "link a < b"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("<!-- <p>no</p> -->yes", "yes"),
    ("<h1>this &amp</h1><p>that</p>", "this & that"),
])
def test_plain_text(spark, html, text):
    from gleaner.functions.html import plain_text
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(plain_text("h").alias("t")).first()["t"] == text


@pytest.mark.parametrize("html,text", [
    ('<body><div class="x content y"><div>inner</div></div>z</body>', "inner"),
    ('<body><div class="content"><div>a</div><div>b</div></div><div>z</div></body>', "a b"),
    ('<body><section role="main"><p>r</p></section><div class="content">c</div></body>', "r"),
    ('<body><div class="entry-content">e</div><div class="post-content">p</div></body>', "p"),
    ("<html><body><p>hello world", "hello world"),
    ("<article>a<article>b</article>c</article>", "a b c"),
    ("<body><nav>x<nav>y</nav>menu</nav>text</body>", "text"),
    ("<article>caf&eacute; it&#8217;s</article>", "caf\u00e9 it\u2019s"),
    ("<!-- <nav> --><body>kept <nav>gone</nav></body>", "kept"),
    ("<p>" * 3000 + "deep", "deep"),
    ("<main>one</main><main>two</main>", "one"),
    ('<body><div data-x="a>b">t</div></body>', "t"),
])
def test_extraction_tree_path(spark, html, text):
    df = spark.createDataFrame([(html,)], "html string")
    assert extract_main_content(df, "html", "t").first()["t"] == text


def test_undefined_setting_is_an_error(spark):
    df = spark.createDataFrame([("s",)], "source string")
    with pytest.raises(KeyError):
        with_settings(df, Config(), {"no_such_key": "string"})


@pytest.mark.parametrize("text,expected", [
    ("2024-01-01T00:00:07Z", datetime(2024, 1, 1, 0, 0, 7)),
    ("2024-01-01T02:00:07+02:00", datetime(2024, 1, 1, 0, 0, 7)),
    ("2024-01-01T00:00:07.123456Z", datetime(2024, 1, 1, 0, 0, 7, 123456)),
    ("1704067207", datetime(2024, 1, 1, 0, 0, 7)),
    ("1704067207999", datetime(2024, 1, 1, 0, 0, 7)),
    ("2024-01-01T00:00:07", datetime(2024, 1, 1, 0, 0, 7)),
    ("garbage", None), ("2024-13-32T19:16:33+00:00", None), (None, None),
    ("99999999999999999999", None), ("999999999999999999", None), ("20240131", datetime(2024, 1, 31)),
    ("20241399", None), ("253402300799", datetime(9999, 12, 31, 23, 59, 59)), ("253402300800", None),
])
def test_parse_item_date(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(shaping.parse_item_date("t").alias("d")).first()["d"] == expected


def test_numbers_out_of_range_take_the_default(spark):
    df = spark.createDataFrame([("99999999999",), ("-99999999999",), ("1_000",), ("++7",), ("2147483647",)], "v string")
    assert [r["i"] for r in df.select(as_int("v", 5).alias("i")).collect()] == [5, 5, 5, 5, 2147483647]


def test_deep_rich_text_does_not_abort(spark):
    deep = '{"type":"doc","content":[' * 400 + '{"type":"text","text":"x"}' + "]}" * 400
    worse = "[" * 200_000 + "]" * 200_000
    odd = '{"type":"mention","attrs":[1]}'
    df = spark.createDataFrame([(deep,), (worse,), (odd,)], "t string")
    got = [r["x"] for r in df.select(shaping.flatten_rich_text("t").alias("x")).collect()]
    assert got[0] == "x" and got[1] in (None, "") and got[2] == ""


def test_native_and_tree_text_agree_on_every_page(spark):
    from conftest import SF_SMALL
    from gleaner.functions import html as h
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    out = pages.select("html", h.needs_tree("html").alias("odd"), h.odd_markup("html").alias("odd_text"),
                       h.plain_text("html").alias("plain"))
    out = h.extract_main_content(out, "html", "main").toPandas()
    assert (~out.odd).any()
    assert (out["main"] == out.html.map(h.extract_main_text_py)).all()
    assert (out.plain == out.html.map(h.plain_text_py)).all()


def test_pages_landed_twice_and_blank_urls(spark):
    feed = spark.createDataFrame([("u1", "<p>a</p>"), ("", "<p>b</p>"), (None, "<p>c</p>")], "url string, html string")
    pages = spark.createDataFrame([("u1", "<article>one two</article>"), ("u1", "<article>one two three</article>"),
                                   ("", "<article>x y z</article>")], "url string, html string")
    got = sorted(rows(shaping.short_content_fallback(feed, pages, 50), "text", "content_from"))
    assert got == [("b", "short"), ("c", "short"), ("one two three", "full")]


def test_caps_are_off_unless_set(spark):
    c = spark.createDataFrame([(i, 20, datetime(2024, 1, 30)) for i in range(300)], "id int, likes int, created timestamp_ntz")
    assert shaping.liked_recent_comments(c, 15, datetime(2024, 1, 1)).count() == 300
    assert shaping.liked_recent_comments(c, 15, datetime(2024, 1, 1), 200).count() == 200


def test_trending_counts_recent_pushes(spark):
    old, new = datetime(2023, 1, 1), datetime(2024, 1, 30)
    r = spark.createDataFrame([("a", 5.0, old, new), ("b", 9.0, old, old), ("c", 7.0, new, None)],
                              "full_name string, stars double, created timestamp_ntz, pushed timestamp_ntz")
    assert rows(shaping.trending(r, datetime(2024, 1, 20), 1).orderBy("rank"), "full_name") == [("c",), ("a",)]


def test_provider_dispatch(spark):
    from gleaner.operators import scorers
    items = spark.createDataFrame([(1, "k1", "t", '{"text": "the data"}', "s1"), (2, "k2", "t", '{"text": "x"}', "s2")],
                                  "ord bigint, dedup_key string, title string, input string, source string")

    def canned(df, model, attempts):
        return df.withColumn("responses", F.array(F.lit("{bad"), F.lit(_resp(42)), F.lit(_resp(43))))

    providers = {"keyword": evaluate.scorer_provider(scorers.keyword_scorer()), "canned": canned}
    cfg = Config(sources={"s2": {"eval_provider": "canned", "eval_model": "m2", "eval_retries": "2"}})
    got = {r["dedup_key"]: r for r in evaluate.answer(items, cfg, providers).collect()}
    assert got["k1"]["model"] == "keyword-v1" and got["k2"]["model"] == "m2"
    assert '"importance_score": 42' in got["k2"]["response_text"] and got["k1"]["prompt_hash"] != got["k2"]["prompt_hash"]
    one = Config(sources={"s2": {"eval_provider": "canned", "eval_retries": "1"}})
    assert [r["dedup_key"] for r in evaluate.answer(items, one, providers).collect()] == ["k1"]
    with pytest.raises(ValueError, match="unknown eval_provider"):
        evaluate.answer(items, Config(base={"eval_provider": "nope"}), providers)


def test_tallied_state_equals_the_direct_one(spark):
    data = [(f"k{i % 3}", i, (i * 37) % 101, (i * 53) % 101, datetime(2024, 1, 1 + i % 28)) for i in range(50)]
    evals = spark.createDataFrame(data, EVAL_SCHEMA)
    parts = evaluate.tally(evals.where("seq < 20")).unionByName(evaluate.tally(evals.where("seq >= 20")))
    assert sorted(evaluate.tallied_state(parts).collect()) == sorted(evaluate.eval_state(evals).collect())


def test_unknown_source_kind_is_an_error():
    from gleaner.sources import builders
    with pytest.raises(ValueError, match="unknown source kind"):
        builders.build("nope", {}, Config(), AS_OF)


def test_missing_creation_date_is_rejected(spark):
    df = spark.createDataFrame([("s", "t", "l", None, "{}"), ("s", "t", "l", "x", "{}")],
                               "source string, title string, link string, creation_date string, input string")
    assert sorted(str(r["reject_reason"]) for r in collect.validate_items(df).collect()) == ["None", "missing_creation_date"]


def test_listing_filters_then_ranks(spark):
    data = [("a", 1, "s", "Alpha", 10, 1), ("b", 2, "s", "beta", 90, 1), ("c", 3, "t", "alphabet", 50, 1), ("d", 4, "s", "alp", 70, 1)]
    store = spark.createDataFrame(data, "dedup_key string, ord bigint, source string, title string, weighted_score int, "
                                        "num_evals int").withColumn("median_confidence", F.lit(1)).withColumn(
        "last_eval", F.lit(None).cast("timestamp_ntz"))
    got = rows(serve.listing(store, term="ALP", source="s").orderBy("rank"), "dedup_key", "rank")
    assert got == [("d", 1), ("a", 2)]
    assert rows(serve.listing(store, min_score=50, by="title", descending=False).orderBy("rank"), "dedup_key") == [
        ("d",), ("c",), ("b",)]


@pytest.mark.parametrize("text, reason", [
    ('{"summary": "a", "summary": "b", "evaluation": "e", "importance_score": 1, "importance_score": 70, "confidence_score": 2}', "valid"),
    ('{"summary": "s", "evaluation": "e", "importance_score": "1", "importance_score": 70, "confidence_score": 2}', "valid"),
    ('{"summary": "s", "evaluation": "e", "importance_score": 70, "importance_score": "1", "confidence_score": 2}', "non_int_importance"),
    ('{"summary": "s", "evaluation": "e", "importance_score": 123456789012345678901234567890, "confidence_score": 2}', "valid"),
    ('{"summary": "s", "evaluation": "e", "importance_score": -12345678901234567890, "confidence_score": 3000000000}', "valid"),
    ('{"summary": "s", "evaluation": "e", "importance_score": 1' + "0" * 40 + ', "confidence_score": 2}', "non_int_importance"),
    ('{"summary": "s", "evaluation": "e", "importance_score": 70.0, "confidence_score": 2}', "non_int_importance"),
    ('{"summary": "s", "evaluation": "e", "importance_score": 7e1, "confidence_score": 2}', "non_int_importance"),
    ('{"summary": NaN, "evaluation": -Infinity, "importance_score": 70, "confidence_score": 2}', "valid"),
    ('{"summary": "s", "evaluation": "e", "importance_score": NaN, "confidence_score": 2}', "non_int_importance"),
    ('{"summary": "NaN, is fine: NaN", "evaluation": "e", "importance_score": 70, "confidence_score": 2}', "valid"),
    ('{"summary": nan, "evaluation": "e", "importance_score": 70, "confidence_score": 2}', "bad_json"),
])
def test_lenient_json_of_responses(spark, text, reason):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(evaluate.response_reason("t").alias("r")).first()["r"] == reason


def test_scores_out_of_range_are_stored_at_its_ends(spark):
    texts = ['{"summary": NaN, "evaluation": "e", "importance_score": 12345678901234567890123, "confidence_score": -3000000000}',
             '{"summary": "s", "evaluation": "e", "importance_score": 1, "importance_score": 70, "confidence_score": 5}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r["x"]) for r in df.select(evaluate.response_scores("t").alias("x")).collect()]
    assert got == [(2 ** 31 - 1, -(2 ** 31), None), (70, 5, "s")]


def test_rows_landed_twice(spark):
    landed = collect.with_dedup_key(spark.createDataFrame(
        [(1, "s", "A1", "a", None, "{}"), (1, "s", "A1", "a", None, "{}"), (2, "s", "B", "b", None, "{}"),
         (2, "s", "B other", "b", None, "{}"), (3, "s", "A2", "a", None, "{}"), (4, "s", "C", None, None, "{}")], ITEM))
    assert sorted(rows(collect.dedup_landed_twice(landed), "ord", "title")) == [(1, "A1"), (2, "B")]
    assert set(collect.dedup_landed_twice(landed).columns) == set(landed.columns)
    assert sorted(rows(collect.repeated_positions(landed), "ord", "rows")) == [(1, 2), (2, 2)]
    assert collect.repeated_positions(collect.dedup_landed_twice(landed)).count() == 0


def test_sketched_medians_keep_their_rank_error(spark):
    """Any split into rounds and any order of merging stays within the rank error."""
    n = 300_000
    values = {"even": F.col("id") % 101, "lumps": F.when(F.col("id") % 3 == 0, 90).otherwise(F.col("id") % 7),
              "sorted": F.floor(F.col("id") / 1000), "one": F.lit(50)}
    for name, value in values.items():
        evals = spark.range(n).select(F.lit("s").alias("source"), (F.xxhash64("id") % 9).alias("round"),
                                      value.cast("int").alias("confidence_score")).checkpoint()
        parts = evaluate.confidence_sketches(evals, ["source", "round"])
        pair = parts.withColumn("half", F.pmod("round", F.lit(2)))
        ways = [evaluate.confidence_sketches(evals, ["source"]), evaluate.merged_sketches(parts, ["source"]),
                evaluate.merged_sketches(evaluate.merged_sketches(pair, ["source", "half"]), ["source"])]
        for way in ways:
            for share in (0.1, 0.5, 0.99):
                row = way.select(evaluate.sketched_count().alias("n"), evaluate.sketched_quantile(share=share).alias("q")).first()
                assert row["n"] == n
                below, upto = evals.select(F.count_if(F.col("confidence_score") < row["q"]),
                                           F.count_if(F.col("confidence_score") <= row["q"])).first()
                assert below / n <= share + evaluate.RANK_ERROR and upto / n >= share - evaluate.RANK_ERROR, (name, share)


def test_small_groups_have_exact_sketches(spark):
    evals = spark.createDataFrame([("a", c) for c in (5, 1, 9, 1)] + [("b", 7), ("b", None), ("c", None)], "source string, confidence_score int")
    got = evaluate.confidence_sketches(evals, ["source"]).select(
        "source", evaluate.sketched_count().alias("n"), evaluate.sketched_quantile().alias("m")).collect()
    assert sorted(map(tuple, got)) == [("a", 4, 1), ("b", 1, 7)]


def _nested(depth):
    return '{"type":"p","content":[' * depth + '{"type":"text","text":"deep"}' + "]}" * depth


RICH = [
    '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"mention","attrs":{"label":"@x"}},{"type":"text","text":" hi"}]}]}',
    '[{"type":"text","text":"a"},{"type":"text","text":"b"},"loose",5,null,[{"type":"text","text":"c"}]]',
    '{"type":"doc","content":{"type":"text","text":"single"}}', '{"type":"image"}', '{"type":"image","attrs":{"alt":"a cat"}}',
    '{"type":"image","attrs":{"alt":""}}', '{"type":"mention"}', '{"type":"mention","attrs":null}', '{"type":"mention","attrs":{}}',
    '{"type":"contract-mention","attrs":{"label":"q"},"content":[{"type":"text","text":"not shown"}]}',
    '{"type":"mention","content":[{"type":"text","text":"shown"}]}', '{"type":"text"}', '{"type":"text","text":null}',
    '{"type":"text","text":12}', '{"type":"text","text":0}', '{"type":"text","text":true}', '{"type":"text","text":false}',
    '{"type":"text","text":"0"}', '{}', '[]', '"just text"', "17", "null", "{not json", "", None, '{"content":[]}', '{"type":"x","content":7}',
    '{"type":"doc","content":[' + ",".join('{"type":"text","text":"%d "}' % i for i in range(30)) + "]}",
    _nested(20), _nested(490),
]


def test_rich_text_walk_equals_the_tree(spark):
    df = spark.createDataFrame(list(enumerate(RICH)), "k int, tree string")
    want = {r["k"]: r["flat"] for r in df.select("k", shaping.flatten_rich_text("tree").alias("flat")).collect()}
    walked = shaping.flatten_rich_text_walk(df, "k", "tree")
    assert {r["k"]: r["flat"] for r in walked.collect()} == want
    assert want[len(RICH) - 1] == "deep"
    assert "Python" not in walked._jdf.queryExecution().executedPlan().toString()
