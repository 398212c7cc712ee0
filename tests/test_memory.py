import datetime as dt

from test_folds import row, table

from sagaledger.operators import memory, packing

DAY = [dt.datetime(2024, 1, d) for d in range(1, 10)]


def test_fields_are_cleaned(spark):
    rows = spark.createDataFrame(
        [(1, "event", "Negative", "DREAMED", "character_claim", None, "limited", ["A", " "], ["A", "B"], "achieved", "Major"), (2, "resolved", None, "odd", "character_claim", "Jun", "limited", [], None, "achieved", "major")],
        "id int, predicate string, polarity string, modality string, source string, asserted_by string, knowledge string, known_by array<string>, hidden_from array<string>, outcome string, salience string")
    a, b = memory.cleaned_fields(rows).orderBy("id").collect()
    assert (a.polarity, a.modality, a.source, a.known_by, a.hidden_from, a.knowledge, a.outcome, a.salience) == ("negative", "dreamed", "narration", ["A"], ["B"], "limited", None, "major")
    assert (b.polarity, b.modality, b.source, b.asserted_by, b.knowledge, b.outcome, b.salience) == ("positive", "actual", "character_claim", "Jun", "unknown", "achieved", None)


def test_memory_view_folds_over_resolved_names(spark):
    rows = table(spark, [row(1, 1, "Kim Hana", "also_called", "Hana"), row(2, 2, "Hana", "has_status", "ill"), row(3, 3, "Kim Hana", "has_status", "well"), row(4, 4, "Jun", "has_status", "calm")])
    owner = spark.createDataFrame([], "conv_id string, id bigint, kind string, type string, name string, other string, created_at timestamp")
    view = memory.memory_view(rows, owner)
    facts = {(r.subject, r.value) for r in view["facts"].filter("predicate = 'has_status'").collect()}
    assert facts == {("Kim Hana", "well"), ("Jun", "calm")}
    assert {r.value for r in memory.memory_view(rows, owner, upto=2)["facts"].filter("predicate = 'has_status'").collect()} == {"ill"}


def test_memory_view_makes_no_frame_for_each_chat_and_joins_nothing_in_the_driver(spark):
    owner = spark.createDataFrame([], "conv_id bigint, id bigint, kind string, type string, name string, other string, created_at timestamp")
    null = ("object", "object_type", "asserted_by", "outcome", "knowledge", "because")
    rows = spark.range(40).selectExpr("id", "id % 4 AS conv_id", "id AS position", "CAST(id AS INT) AS turn", "IF(id < 20, 'Hana', 'hana') AS subject", "'character' AS subject_type", "'has_status' AS predicate", "CAST(id AS STRING) AS value",
        "'positive' AS polarity", "'actual' AS modality", "'narration' AS source", *[f"CAST(NULL AS STRING) AS {c}" for c in null], "CAST(NULL AS ARRAY<STRING>) AS hidden_from")
    facts = memory.memory_view(rows, owner)["facts"]
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "InPandas" not in plan
    assert {(r.conv_id, r.id, r.subject) for r in facts.collect()} == {(c, 36 + c, "Hana") for c in range(4)}


def test_only_what_is_not_restated_is_dropped(spark):
    old = table(spark, [row(1, 1, "Hana", "has_trait", "likes the old harbor"), row(2, 1, "Hana", "goal", "find the map"), row(3, 1, "Jun", "goal", "cook")])
    new = table(spark, [row(4, 1, "hana", "has_trait", "likes the old harbour"), row(5, 1, "Hana", "goal", "Find the map")])
    assert [r.id for r in memory.restated(old, new).collect()] == [3]


def test_endings_need_listing_evidence_and_a_party(spark):
    answers = spark.createDataFrame([("c", 1, "a", "Jun left the house for good"), ("c", 1, "b", "Jun left the house for good"), ("c", 1, "c", "never said at all anywhere"), ("c", 1, "x", "Jun left")], "conv_id string, turn int, item string, evidence string")
    listed = spark.createDataFrame([("c", 1, "a", "Jun"), ("c", 1, "b", "Mira"), ("c", 1, "c", "Jun")], "conv_id string, turn int, item string, party string")
    turns = spark.createDataFrame([("c", 1, "That night Jun left the house for good.")], "conv_id string, turn int, text string")
    got = {r.item: r.why for r in memory.accepted_endings(answers, listed, turns).collect()}
    assert got == {"a": "accepted", "b": "party not named", "c": "no evidence", "x": "not listed"}


def test_unchecked_reveals(spark):
    turns = spark.createDataFrame([("c", t, DAY[1]) for t in range(1, 5)], "conv_id string, turn int, extracted_at timestamp")
    secrets = spark.createDataFrame([("c", 2, DAY[4])], "conv_id string, turn int, created_at timestamp")
    checks = spark.createDataFrame([("c", 3, DAY[5]), ("c", 4, DAY[3])], "conv_id string, turn int, created_at timestamp")
    assert [r.turn for r in memory.unchecked_reveals(turns, secrets, checks).collect()] == [4]


def test_summaries_written_too_early_or_telling_too_much(spark):
    s = spark.createDataFrame([("c", "w1", 8, DAY[2]), ("c", "w2", 1, DAY[2])], "conv_id string, window string, last_turn int, created_at timestamp")
    x = spark.createDataFrame([("c", 5, DAY[3])], "conv_id string, turn int, created_at timestamp")
    assert [r.window for r in memory.stale_summaries(s, x).collect()] == ["w1"]
    texts = spark.createDataFrame([("c", "a", "Hana is a witch, they say", 1), ("c", "b", "a quiet day", 2)], "conv_id string, ref string, text string, turn int")
    secret = spark.createDataFrame([("c", "Jun", "Hana is a witch")], "conv_id string, name string, secret string")
    none = spark.createDataFrame([], "conv_id string, name string")
    assert [r.ref for r in memory.summary_gate(texts, secret, none).collect()] == ["b"]
    assert [r.ref for r in memory.chronicle(texts, secret).collect()] == ["b"]


def test_replay_reproduces_its_own_policy(spark):
    lines = spark.createDataFrame([(1, n, 60, k, f"r{n}", t, None, False) for n, (k, t) in enumerate([("fact", "a" * 60), ("fact", "b" * 90), ("excerpt", "c" * 80)])], "request_id int, n int, budget int, kind string, ref string, text string, head string, private boolean")
    then = packing.pack(lines)
    (r,) = memory.replay(lines, then).collect()
    assert r.reproduced and r.changed == 0
    (r,) = memory.replay(lines, then, "v0").collect()
    assert not r.reproduced


def test_canon_in_force(spark):
    entries = spark.createDataFrame([("c", "card", "card", "1"), ("c", "lore1", "lore", "2"), ("c", "lore2", "lore", "3")], "conv_id string, key string, kind string, hash string")
    seen = spark.createDataFrame([("c", "lore1")], "conv_id string, key string")
    assert {r.key for r in memory.canon_in_force(entries, seen).collect()} == {"card", "lore1"}
