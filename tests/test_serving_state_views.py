import datetime as dt

from pyspark.sql import functions as F

from sagaledger.operators import coverage, packing, retrieval, serving, state, views


def test_one_generation_serves_a_unit(spark):
    live = spark.createDataFrame([("u", "old", 1), ("u", "mid", 2), ("v", "old", 1), ("v", "act", 0)], "unit string, generation string, activated_at int")
    got = {(r.unit, r.generation) for r in serving.chosen_generation(live, "act", ["unit"]).collect()}
    assert got == {("u", "mid"), ("v", "act")}


def test_discarded_rows_serve_earlier_times(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    rows = spark.createDataFrame([("k", 1, t[0], t[2]), ("k", 2, t[2], None)], "k string, v int, created_at timestamp, discarded_at timestamp")
    at = spark.createDataFrame([("k", t[1]), ("k", t[2]), ("k", t[4])], "k string, at timestamp")
    assert sorted((r.at, r.v) for r in serving.as_of_many(at, rows, ["k"]).collect()) == [(t[1], 1), (t[2], 2), (t[4], 2)]


def test_latest_before_is_strict(spark):
    new = spark.createDataFrame([("k", 1, 5), ("k", 2, 1), ("j", 3, 9)], "k string, id int, created_at int")
    old = spark.createDataFrame([("k", 1, 10), ("k", 4, 11), ("k", 5, 12)], "k string, created_at int, v int")
    assert {r.id: r.previous and r.previous.v for r in serving.latest_before(new, old, ["k"]).collect()} == {1: 11, 2: None, 3: None}


def test_rules_read_status(spark):
    rules = [{"id": "b", "kind": "block", "open": "<status>", "close": "</status>"}, {"id": "r", "kind": "regex", "pattern": r"HP (?P<value>\d+)", "key": "hp"}]
    m = spark.createDataFrame([("c", 1, "x <status>Mood: calm\nGold = 3</status> HP 4 HP 5")], "conv_id string, position int, text string")
    got = {(r.rule_id, r.key): r.value for r in state.observations(m, rules).collect()}
    assert got == {("b", "Mood"): "calm", ("b", "Gold"): "3", ("r", "hp"): "5"}
    assert state.rules_version(rules) != state.rules_version(rules[:1])


def test_change_text(spark):
    df = spark.createDataFrame([("10", "12"), ("1,000", "900"), ("3 / 10", "5 / 12"), ("a, b, c", "a, c, d"), ("x", "y"), ("5", "5"), (None, "1")], "b string, a string")
    assert [r[0] for r in df.select(state.change_text(F.col("b"), F.col("a"))).collect()] == ["+2", "−100", "+2, max +2", "+d · −b", None, None, None]


def test_islands_and_core_keys(spark):
    rows = spark.createDataFrame([("c", "mood", p, v) for p, v in enumerate("aabbba")] + [("c", "hp", p, str(p)) for p in range(6)] + [("c", "date", p, "1") for p in range(6)], "conv_id string, key string, position int, value string")
    got = [(r.value, r.first_position, r.last_position) for r in state.islands(rows.filter("key = 'mood'"), ["conv_id", "key"], ["position"], "value", "position").orderBy("island").collect()]
    assert got == [("a", 0, 1), ("b", 2, 4), ("a", 5, 5)]
    assert {r.key for r in state.core_keys(rows, ["conv_id"], "position").collect()} == {"hp", "date"}


def test_fusion_abstains_without_a_strong_signal(spark):
    weak = spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, True)], "request_id int, rev_id string, rank int, strong boolean")
    assert {r.request_id for r in retrieval.fuse({"x": weak, "y": weak}).collect()} == {2}


def test_nearest_equals_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, [float(k) for k in row]) for i, row in enumerate(x)] + [(900, [0.0] * 8), (901, [1.0])], "rev_id bigint, embedding array<double>")
    asked = v.filter("rev_id % 20 = 0 and rev_id < 300").withColumnRenamed("rev_id", "query_id")
    got = retrieval.nearest(v, asked, 5).collect()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    plain = lambda rows: sorted((r.query_id, r["rank"], r.rev_id, round(r.sim, 9)) for r in rows)
    assert plain(retrieval.nearest(v, asked, 5).collect()) == plain(got)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 300, 20):
        assert [r.rev_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == np.argsort(-(unit @ unit[i]), kind="stable")[:5].tolist()


def test_keyword_route_drops_common_words(spark):
    corpus = spark.createDataFrame([("c", f"r{i}", i, t) for i, t in enumerate(["the lighthouse keeper", "a quiet keeper", "keeper of bees", "nothing here"])], "conv_id string, rev_id string, position int, text string")
    asked = spark.createDataFrame([(1, "c", "where is the lighthouse keeper")], "request_id int, conv_id string, query string")
    assert [r.rev_id for r in retrieval.keyword_route(asked, corpus).collect()] == ["r0"]


def test_quotes_and_excerpts():
    (q,) = retrieval.quote_spans('"Meet me at dawn," Hana said.')
    assert q["quote"] == "Meet me at dawn," and q["speaker"] == "Hana"
    text = "One day it rained. The keeper lit the lamp. Then all slept."
    assert retrieval.best_excerpt(text, "who lit the lamp", ["keeper"], sentences=1) == "…The keeper lit the lamp.…"


LINES = [{"kind": k, "text": t, "head": None, "private": False} for k, t in [("excerpt", "x" * 200), ("fact", "a fact"), ("state", "s" * 400), ("fact", "a fact"), ("thread", "t" * 60)]]


def test_packing_keeps_order_caps_and_reasons():
    small = packing.pack_lines(LINES, 5)
    assert not any(e.placed for e in small)
    got = packing.pack_lines(LINES, 200)
    assert [e.why for e in got] == ["placed", "placed", "state_cap", "restated", "placed"]
    assert sum(e.tok for e in got if e.placed) <= 200
    assert [e.why for e in packing.pack_lines(LINES, 200, "v0")].count("state_cap") == 0
    fit = packing.fits_at([line for line in LINES if line["kind"] != "state"], 30)
    assert fit is not None and fit % packing.FIT_STEP == 0


def test_strict_mode_hides_private_lines(spark):
    rows = spark.createDataFrame([(1, ["A"], ["B"], 1, "secret one", "fact"), (1, ["A"], ["B"], 2, "secret two", "fact"), (1, [], [], 3, "open", "fact")], "request_id int, holders array<string>, missing array<string>, n int, text string, kind string")
    got = sorted((r.kind, r.text) for r in packing.strict_mode(rows).collect())
    assert got == [("fact", "open"), ("secret", "Something known to A, not known to B.")]


def test_evidence_and_names(spark):
    df = spark.createDataFrame([("the keeper lit the lamp", "Then the keeper lit the old lamp again", "Hana", "Hanako came"), ("short", "a short one", "하나", "어제 하나가 왔다"), ("not said ever anywhere", "other words", "하나", "또하나")], "q string, shown string, n string, t string")
    got = df.select(views.quoted_in(F.col("q"), F.col("shown")).alias("q"), views.mentioned(F.col("n"), F.col("t")).alias("m")).collect()
    assert [(r.q, r.m) for r in got] == [(True, False), (True, True), (False, False)]
    assert views.unconditional("{{#if x}}a{{/if}} a", "a") and not views.unconditional("{{#if x}}a{{/if}}", "a")


def test_injected_before_the_last_user_run(spark):
    prompt = [("system", "s"), ("user", "1"), ("char", "2"), ("user", "3"), ("user", "4")]
    df = spark.createDataFrame([(prompt,)], "p array<struct<role:string,text:string>>")
    (r,) = df.select(views.injected(F.col("p"), F.lit("P")).alias("x")).collect()
    assert [m.text for m in r.x] == ["s", "1", "2", "P", "3", "4"]


def test_coverage_of_nothing_is_complete(spark):
    units = spark.createDataFrame([("c", True, None, False, False)], "conv_id string, compiled boolean, job string, historical boolean, truncated boolean")
    (r,) = coverage.extraction_coverage(units).collect()
    assert r.percent == 100.0 and r.complete
