import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sagaledger.functions import text as fx
from sagaledger.operators import retrieval


def grams(text):
    return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)]


def similarity(query, text):
    """The definition, extent by extent."""
    want, seq = set(grams(query)), grams(text)
    best = 0.0
    for a in range(len(seq)):
        shared, other = set(), set()
        for g in seq[a:]:
            (shared if g in want else other).add(g)
            best = max(best, len(shared) / (len(want) + len(other)))
    return best


def talk(rng, n):
    return " ".join("".join(rng.choices(["an", "dra", "gon", "lo", "s", "éa"], k=rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("cells", [1 << 20, 1])
def test_extent_similarity_equals_the_definition(spark, monkeypatch, cells):
    monkeypatch.setattr(fx, "EXTENT_CELLS", cells)
    rng = random.Random(4)
    pairs = [("word", "two words"), ("", "a"), ("a", ""), ("...", "a"), *[(talk(rng, rng.randint(1, 6)), talk(rng, rng.randint(1, 30))) for _ in range(150)]]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    assert [fx.extent_similarity(plain(q), plain(t)) for q, t in pairs] == [similarity(q, t) for q, t in pairs]
    assert similarity("word", "two words") == 0.8  # the value that pg_trgm's manual gives
    if cells > 1:
        got = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "q string, t string").select(fx.word_similarity(F.col("q"), F.col("t")).alias("s")).collect()
        assert [r.s for r in got] == [*[similarity(q, t) for q, t in pairs], 0.0, 0.0]


CORPUS = "conv_id string, rev_id string, position int, text string"


def test_lexical_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [(c, f"{c}{i}", i, talk(rng, rng.randint(1, 25))) for c in "ab" for i in range(40)]
    asked = [(1, "a", talk(rng, 3), talk(rng, 20)), (2, "b", talk(rng, 4), None), (3, "b", "an", "lo")]
    hits = {r: [(similarity(q, t), similarity(reply, t), p, i) for c, i, p, t in texts if c == conv and similarity(q, t) >= 0.4] for r, conv, q, reply in asked}
    sizes = sorted(len(h) for h in hits.values())
    assert 0 < sizes[0] < sizes[-1]
    for broad in (200, sizes[0]):
        got = retrieval.lexical(spark.createDataFrame(asked, "request_id int, conv_id string, query string, reply string"), spark.createDataFrame(texts, CORPUS), broad=broad, limit=7).collect()
        want = set()
        for r, found in hits.items():
            best = sorted(found, key=lambda h: (-round(h[0] + 0.2 * h[1], 9), -h[2]))[:7] if len(found) <= broad else []
            want |= {(r, i, round(u, 9), round(u + 0.2 * v, 9), n) for n, (u, v, _, i) in enumerate(best, 1)}
        assert want and {(r.request_id, r.rev_id, round(r.user_score, 9), round(r.score, 9), r["rank"]) for r in got} == want


def test_scattered_trigrams_match_nothing_and_make_no_request_broad(spark):
    parts = ["dragon", "sleeps", "under", "hills"]
    long = " ".join(f"{p} {' '.join(f'{chr(97 + k)}{i}q{k}{i}x' for k in range(12))}" for i, p in enumerate(parts))
    corpus = spark.createDataFrame([("c", f"r{i}", i, long) for i in range(5)] + [("c", "hit", 9, "so the dragon sleeps under hills")], CORPUS)
    asked = spark.createDataFrame([(1, "c", "dragon sleeps under hills", None)], "request_id int, conv_id string, query string, reply string")
    assert [r.rev_id for r in retrieval.lexical(asked, corpus, broad=3).collect()] == ["hit"]


def test_keywords_match_by_the_exact_measure_and_count_every_match(spark):
    texts = ["two dragons came", "dragonflies over the lake", "a dragon", "dragged on", "nothing here", "nor here", "a keeper", "still nothing"]
    corpus = spark.createDataFrame([("c", f"r{i}", i, t) for i, t in enumerate(texts)], CORPUS)
    asked = spark.createDataFrame([(1, "c", "where did the dragon go")], "request_id int, conv_id string, query string")
    found = {i for i, t in enumerate(texts) if similarity("dragon", t) >= 0.8}
    assert found == {0, 1, 2}
    got = {(r.rev_id, r.keyword_score) for r in retrieval.keyword_route(asked, corpus).collect()}
    assert got == {(f"r{i}", round(math.log(len(texts) / len(found)), 4)) for i in found}
    # With two more matches the word is in more than half of the chat and counts for nothing.
    more = spark.createDataFrame([("c", "x", 20, "dragons"), ("c", "y", 21, "dragonfly"), ("c", "z", 22, "dragoon and dragons")], CORPUS)
    assert retrieval.keyword_route(asked, corpus.unionByName(more)).collect() == []


def test_a_packet_of_all_parts(spark):
    from sagaledger.operators import recall

    talk_ = [(0, "Hana said \"the old lighthouse burns\" and left."), (1, "It rained all day."), (2, "The lighthouse keeper found a map of the coast."), (3, "They ate bread."), (4, "A boat came from the north.")]
    corpus = spark.createDataFrame([("c", f"c:{i}", i, t) for i, t in talk_], CORPUS)
    asked = spark.createDataFrame([(1, "c", "what about the lighthouse keeper", "It rained.", [1.0, 0.0])], "request_id int, conv_id string, query string, reply string, embedding array<double>")
    facts = spark.createDataFrame([("c", 7, "has_status", ["lighthouse keeper"], "the keeper is ill", 2, ["Jun"]), ("c", 8, "event", ["nobody"], "a feast", 3, [])], "conv_id string, id bigint, predicate string, names array<string>, text string, position int, missing array<string>")
    threads = spark.createDataFrame([("c", 9, "goal", "keeper", None, "find the coast", 2, "open")], 'conv_id string, id bigint, kind string, `by` string, `to` string, text string, turn int, status string')
    vectors = spark.createDataFrame([("c", "c:4", 4, [0.0, 1.0]), ("c", "c:4", 4, [0.9, 0.1]), ("c", "c:3", 3, [0.1, 0.9])], "conv_id string, rev_id string, position int, embedding array<double>")
    history = spark.createDataFrame([("c", "The lighthouse keeper found a map", "nothing like it", 4)], "conv_id string, old_value string, new_value string, turn int")
    whole = recall.Memory(facts, threads, vectors, None)
    got = recall.retrieve(asked, corpus, whole, budget=400).collect()
    parts = {(r.kind, r.ref) for r in got if r.placed}
    assert {("fact", "7"), ("thread", "9"), ("quote", "c:0#10"), ("excerpt", "c:2"), ("excerpt", "c:4")} <= parts and not {("fact", "8"), ("excerpt", "c:3")} & parts
    assert [r.kind for r in sorted(got, key=lambda r: r.n)] == sorted([r.kind for r in got], key=recall.packing.ORDER.index)
    assert {r.kind: r.offered for r in recall.trace(spark.createDataFrame(got)).collect()}["fact"] == 1
    private = {r.ref: r.private for r in recall.gather(asked, corpus, whole).filter("kind = 'fact'").collect()}
    assert private == {"7": True}
    later = recall.retrieve(asked, corpus, recall.Memory(history=history), budget=400).collect()
    assert ("excerpt", "c:2") not in {(r.kind, r.ref) for r in later} and {r.kind for r in later} <= {"excerpt", "quote"}


def test_standing_parts_of_a_packet(spark):
    from sagaledger.operators import recall

    corpus = spark.createDataFrame([("c", f"c:{i}", i, f"line {i} of talk") for i in range(4)] + [("d", "d:0", 0, "elsewhere")], CORPUS)
    asked = spark.createDataFrame([(1, "c", "how much gold has Hana", "Bo left."), (2, "d", "hello", None)], "request_id int, conv_id string, query string, reply string")
    memory = recall.Memory(
        story=spark.createDataFrame([("c", "once upon a time")], "conv_id string, text string"),
        scenes=spark.createDataFrame([("c", w, f"scene {w}") for w in range(4)], "conv_id string, window int, text string"),
        state=spark.createDataFrame([("c", "hp", "9", 3), ("c", "gold", "12", 1), ("d", "gold", "1", 0)], "conv_id string, key string, value string, position int"),
        cast=spark.createDataFrame([("c", 1, ["hana"], "Hana, a smith"), ("c", 2, ["Bo", "Bob"], "Bo, a guard"), ("c", 3, ["Cy"], "Cy, a bard"), ("d", 4, ["hana"], "another Hana")], "conv_id string, id bigint, names array<string>, text string"))
    got = recall.gather(asked, corpus, memory).orderBy("request_id", "n").collect()
    lines = [(r.kind, r.ref, r.text) for r in got if r.request_id == 1]
    assert lines[:2] == [("state", "gold", "gold: 12"), ("state", "hp", "hp: 9")]
    assert [x for x in lines if x[0] == "story"] == [("story", "story", "once upon a time")]
    assert [x[1] for x in lines if x[0] == "lead"] == ["scene 3", "scene 2"]
    assert [x[1] for x in lines if x[0] == "cast"] == ["1", "2"]
    assert [(r.kind, r.ref) for r in got if r.request_id == 2] == [("state", "gold")]


def test_hidden_facts_causes_and_first_cues(spark):
    schema = "conv_id string, id bigint, predicate string, names array<string>, text string, position int, hidden boolean, causes array<bigint>"
    facts = spark.createDataFrame([("c", 1, "event", ["hana"], "Hana met Bo", 1, False, []), ("c", 2, "event", ["hana"], "Hana met Bo", 5, False, [4]), ("c", 3, "goal", ["bo"], "Bo hides gold", 3, True, []), ("c", 4, "event", ["nobody"], "a storm", 0, False, []), ("c", 5, "goal", ["far away"], "x", 9, False, [])], schema)
    ask = lambda q, r, first: spark.createDataFrame([(1, "c", q, r, first)], "request_id int, conv_id string, query string, reply string, first boolean")
    ids = lambda q, r=None, first=False: [x.id for x in retrieval.relevant_facts(ask(q, r, first), facts).orderBy("rank").collect()]
    assert ids("where did Hana go") == [2, 1, 4], "a cause stands below what it caused"
    assert ids("how did Hana come", first=True) == [1, 2, 4], "the earliest of equals first"
    assert ids("nothing", "Bo was here") == [] and ids("what does Bo want") == [3], "what is hidden needs the message itself"


def asked_and_told(spark):
    """Six requests of which three ask the same, and facts of their chat, from tables whose size the planner knows."""
    asked = spark.range(6).selectExpr("id AS request_id", "1L AS conv_id", "IF(id % 2 = 0, 'where is Hana', 'and Jun?') AS query", "CAST(NULL AS STRING) AS reply")
    told = spark.range(20).selectExpr("1L AS conv_id", "id", "'has_status' AS predicate", "array(IF(id % 2 = 0, 'Hana', 'Jun')) AS names", "'ill since ' || id AS text", "id AS position")
    return asked, told


def test_fact_relevance_joins_nothing_in_the_driver_and_answers_all_who_ask_the_same(spark):
    asked, told = asked_and_told(spark)
    rows = retrieval.relevant_facts(asked, told, limit=3)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.request_id, r.id, r.rank) for r in rows.collect()} == {(q, 18 + q % 2 - 2 * n, n + 1) for q in range(6) for n in range(3)}


def test_thread_relevance_joins_nothing_in_the_driver_and_answers_all_who_ask_the_same(spark):
    asked, told = asked_and_told(spark)
    threads = told.selectExpr("conv_id", "id", "text", "names[0] AS by", "CAST(NULL AS STRING) AS to", "id AS turn", "'open' AS status")
    rows = retrieval.relevant_threads(asked, threads, limit=3)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.request_id, r.id, r.mention, r.rank) for r in rows.collect()} == {(q, 18 + q % 2 - 2 * n, 2, n + 1) for q in range(6) for n in range(3)}
