import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sagaledger.operators import entities, folds
from sagaledger.operators._grouped import fold_groups

SCHEMA = "id bigint, conv_id string, position int, turn int, subject string, subject_type string, predicate string, object string, object_type string, value string, polarity string, modality string, source string, asserted_by string, knowledge string, hidden_from array<string>, outcome string, because string"


def row(id, turn, subject, predicate, value=None, object=None, polarity="positive", source="narration", subject_type="character", **more):
    out = {"id": id, "conv_id": "c", "position": turn, "turn": turn, "subject": subject, "subject_type": subject_type, "predicate": predicate, "object": object, "object_type": None, "value": value, "polarity": polarity,
           "modality": "actual", "source": source, "asserted_by": None, "knowledge": "public", "hidden_from": None, "outcome": None, "because": None}
    return out | more


def table(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def folded(spark, rows):
    got = {r.id: r for r in folds.versions(table(spark, rows)).collect()}
    return [got[r["id"]] for r in rows]


def test_a_newer_value_supersedes_and_a_denial_ends(spark):
    outcomes = lambda rows: [r.outcome for r in folded(spark, rows)]
    a = [row(1, 1, "Hana", "has_status", "ill"), row(2, 2, "Hana", "has_status", "well")]
    assert outcomes(a) == ["superseded", "current"]
    a.append(row(3, 3, "Hana", "has_status", "well", polarity="negative"))
    assert outcomes(a) == ["superseded", "ended", "current"]
    b = [row(1, 1, "Hana", "has_status", "ill"), row(2, 2, "Hana", "has_status", "well", polarity="negative")]
    assert outcomes(b) == ["current", "current"], "a denial of something else stands beside"


def test_an_item_has_one_whereabouts(spark):
    outcomes = lambda rows: [r.outcome for r in folded(spark, rows)]
    held = [row(1, 1, "Hana", "possesses", object="map"), row(2, 2, "map", "located_in", object="library", subject_type="item")]
    assert outcomes(held) == ["superseded", "current"]
    same_turn = [row(1, 2, "Hana", "possesses", object="map"), row(2, 2, "map", "located_in", object="library", subject_type="item")]
    assert outcomes(same_turn) == ["current", "current"]
    burnt = [row(1, 1, "Hana", "possesses", object="map"), row(2, 2, "map", "destroyed", "burned", subject_type="item")]
    assert outcomes(burnt) == ["ended", "current"]
    back = [*burnt, row(3, 3, "Jun", "possesses", object="map")]
    got = folded(spark, back)
    assert [r.outcome for r in got] == ["ended", "conflicting", "current"] and got[2].disputed


def test_relationships_of_a_pair(spark):
    outcomes = lambda rows: [r.outcome for r in folded(spark, rows)]
    a = [row(1, 1, "A", "relationship", "mentor", "B"), row(2, 2, "B", "relationship", "student", "A")]
    assert outcomes(a) == ["current", "current"]
    a.append(row(3, 3, "A", "relationship", "friends", "B"))
    assert outcomes(a) == ["superseded", "superseded", "current"]
    a.append(row(4, 4, "B", "relationship", "friends", "A", polarity="negative"))
    assert outcomes(a) == ["superseded", "superseded", "ended", "current"]
    both = lambda v: spark.createDataFrame([(v,)], "v string").select(folds.is_symmetric(folds.F.col("v")).alias("b")).first().b
    assert both("소꿉친구 사이") and not both("friend of her brother") and not both(None) and not both("")


def test_grouped_fold_equals_its_window_form(spark):
    rows = [row(i, i, f"p{i % 3}", "has_status", f"v{i % 2}") for i in range(30)]
    general = {(r.id, r.outcome, r.closed_turn) for r in folds.versions(table(spark, rows)).collect()}
    window = {(r.id, r.outcome, r.closed_turn) for r in folds.single_slot_versions(table(spark, rows), ["conv_id", "subject"], ["position"]).collect()}
    assert general == window


def test_validity(spark):
    rows = [row(1, 1, "A", "flies", "x"), row(2, 1, "A", "goal", ""), row(3, 1, "A", "located_in", object="town"), row(4, 1, "A", "possesses"), row(5, 1, "A", "located_in", object="x", object_type="item")]
    got = {r.id: r.reason for r in folds.validity(table(spark, rows)).collect()}
    assert got == {1: "unknown predicate", 2: "no value", 3: None, 4: "no object", 5: "object type"}


def test_threads_open_close_and_stay_ambiguous(spark):
    rows = [
        row(1, 1, "Hana", "promised", "meet at the lighthouse", "Jun"),
        row(2, 2, "Hana", "promised", "when the rain stops, meet at the lighthouse", "Jun"),
        row(3, 3, "Hana", "fulfilled", "meet at the lighthouse"),
        row(4, 4, "Jun", "goal", "find the old map"), row(5, 5, "Jun", "goal", "cook dinner"),
        row(6, 6, "Jun", "resolved", "find the old map", outcome="achieved"),
        row(7, 7, "Mira", "promised", "sing a song", "Jun", polarity="negative"),
        row(8, 8, "Jun", "goal", "leave town", source="character_claim", asserted_by="Hana"),
    ]
    got = {r.id: (r.status, r.restated) for r in folds.threads(table(spark, rows)).collect()}
    assert got == {1: ("kept", 1), 4: ("achieved", 0), 5: ("open", 0)}


def test_secrets_end_for_who_learned_them(spark):
    rows = [row(1, 1, "Hana", "identity", "is a witch", knowledge="limited", hidden_from=["Jun", "Mira"]), row(2, 5, "jun", "learned", "is a witch"), row(3, 0, "Mira", "learned", "is a witch")]
    got = {r.name: r.learned_turn for r in folds.secrets_open(table(spark, rows)).collect()}
    assert got == {"jun": 5, "mira": None}


def test_cause_links_need_a_clear_event(spark):
    rows = table(spark, [row(1, 5, "Hana", "has_status", "hurt", because="she fell from the tower")])
    events = table(spark, [row(2, 4, "Hana", "event", "Hana fell from the old tower"), row(3, 4, "Hana", "event", "a feast was held"), row(4, 4, "Jun", "event", "fell from the tower")])
    assert [(r.id, r.event_id) for r in folds.cause_links(rows, events).collect()] == [(1, 2)]


def named(rows, owner=()):
    return {(r["name"]): (r["entity_name"], r["ambiguous"]) for r in entities.resolve_conversation("c", rows, list(owner))}


def test_entities_join_by_alias_unless_it_divides():
    base = [row(1, 1, "Kim Hana", "also_called", "Hana"), row(2, 2, "Lee Hana", "also_called", "Hana")]
    got = named(base)
    assert got["Hana"] == (None, True) and got["Kim Hana"][0] == "Kim Hana" and got["Lee Hana"][0] == "Lee Hana"
    link = {"kind": "link", "id": 1, "type": "character", "name": "Hana", "other": "Kim Hana", "created_at": 1}
    assert named(base, [link])["Hana"] == ("Kim Hana", False)
    split = link | {"kind": "split", "id": 2, "created_at": 2}
    one = [row(1, 1, "Kim Hana", "also_called", "Hana")]
    assert named(one)["Hana"][0] == "Kim Hana" and named(one, [split])["Hana"][0] == "Hana"
    other = [row(1, 1, "Hana", "also_called", "the baker", source="character_claim", asserted_by="Jun")]
    assert "the baker" not in named(other), "only a speaker's own other names count"


def test_resolve_over_conversations(spark):
    rows = table(spark, [row(1, 1, "Kim Hana", "also_called", "Hana")])
    owner = spark.createDataFrame([], "conv_id string, id bigint, kind string, type string, name string, other string, created_at timestamp")
    got = entities.resolve(rows, owner).collect()
    assert len({r.entity_id for r in got}) == 1 and len(got) == 2


def test_name_parts_and_romanization():
    assert entities.name_parts("한서윤") == ["서윤"] and entities.name_parts("Kim Hana") == ["Kim", "Hana"] and entities.name_parts("Jo") == []
    assert entities.romanized("서윤") == "seoyun" and entities.romanized("Hana") == "Hana"


def test_folds_over_a_union_hold_when_its_sides_are_merged_differently(spark):
    # Both sides are dealt by conversation before, the second has far fewer rows, and adaptive execution merges small partitions.
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k) for k in conf}
    counted = lambda n: spark.range(n).select((F.col("id") % 500).alias("conv_id"), F.sha2(F.col("id").cast("string"), 256).alias("x")).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("x")))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        made = fold_groups(counted(20000).unionByName(counted(1000)), ["conv_id"], ["n"], lambda key, rows: [{"conv_id": key[0], "n": len(rows)}], "conv_id bigint, n int")
        got = [(r.conv_id, r.n) for r in made.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == [(c, 42) for c in range(500)]


def test_resolve_equals_one_conversation_at_a_time_and_makes_no_frame_for_each(spark):
    rng = random.Random(7)
    names = ["Hana", "hana ", "Jun", "JUN", "Kim Hana", "?", "", None, "Straße", "STRASSE"]
    rows = []
    for k in range(600):
        more = {"conv_id": f"c{k % 12}", "object": rng.choice(names), "object_type": rng.choice([None, "item"]), "subject_type": rng.choice([None, "character", "item"]), "polarity": rng.choice(["positive", "negative", None]), "asserted_by": rng.choice(names), "modality": rng.choice(["actual", "", None, "dreamed"])}
        rows.append(row(k, rng.randrange(9), rng.choice(names), rng.choice(["also_called", "has_status"]), rng.choice(names), source=rng.choice(["narration", "character_claim", None]), **more))
    links = [(f"c{rng.randrange(14)}", k, rng.choice(["link", "split"]), rng.choice([None, "item"]), rng.choice(names[:5]), rng.choice(names[:5]), dt.datetime(2024, 1, rng.randrange(1, 9))) for k in range(60)]
    owner = spark.createDataFrame(links, "conv_id string, id bigint, kind string, type string, name string, other string, created_at timestamp")
    made = entities.resolve(table(spark, rows), owner)
    want = []
    for conv in sorted({r["conv_id"] for r in rows}):
        mine = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: (r["position"], r["id"]))
        said = [dict(zip(owner.columns, o)) for o in links if o[0] == conv]
        want += [{"conv_id": conv, **r} for r in entities.resolve_conversation(conv, mine, said)]
    assert sorted((tuple(r[c] for c in made.columns) for r in made.collect()), key=repr) == sorted((tuple(r[c] for c in made.columns) for r in want), key=repr)
    assert "InPandas" not in made._jdf.queryExecution().executedPlan().toString()
