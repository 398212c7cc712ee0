import random

import pytest
from pyspark.sql import functions as F

from sagaledger.operators import folds, ledger, repairs, stories


def test_prefix_intact_follows_branches(spark):
    rng = random.Random(5)
    commits, heads, want = [], [], {}
    for conv in range(6):
        n = rng.randint(1, 40)
        up = {i: (None if i == 0 else rng.randrange(max(0, i - 4), i)) for i in range(n)}
        low = {i: rng.choice([None, rng.randint(0, 30)]) for i in range(n)}
        commits += [(conv, i, up[i], low[i]) for i in range(n)]
        head = rng.randrange(n)
        heads.append((conv, head))
        want |= {(conv, i): False for i in range(n)}
        at, least = head, None
        while at is not None:
            want[conv, at] = least is None or least > 10
            least = min((x for x in (least, low[at]) if x is not None), default=None)
            at = up[at]
    c = spark.createDataFrame(commits, "conv_id int, commit_id int, parent_id int, changed int")
    h = spark.createDataFrame(heads, "conv_id int, commit_id int")
    assert {(r.conv_id, r.commit_id): r.intact for r in ledger.prefix_intact(c, h, 10).collect()} == want
    alone = spark.createDataFrame([(1, 1, 77, 3)], c.schema)
    assert ledger.prefix_intact(alone, spark.createDataFrame([(1, 1)], h.schema), 10).first().intact


SAID = "conv_id int, id bigint, position int, turn int, subject string, subject_type string, predicate string, object string, object_type string, value string, polarity string"
MADE = "conv_id int, repair_id bigint, seq int, kind string, turn int, subject string, subject_type string, predicate string, object string, object_type string, value string, polarity string, new_value string, from_turn int, turn_hash string"


def said(i, turn, value, predicate="has_status", subject="Ann", obj=None, position=None):
    return (1, i, turn * 10 if position is None else position, turn, subject, "character", predicate, obj, None, value, "positive")


def made(i, kind, turn, value, new=None, at=None, turn_hash=None, predicate="has_status", subject="Ann", obj=None):
    return (1, i, i, kind, turn, subject, "character", predicate, obj, None, value, "positive", new, at, turn_hash)


def merged(spark, statements, repairs_):
    turns = spark.createDataFrame([(1, t, t * 10 + 9, f"h{t}") for t in range(1, 6)], "conv_id int, turn int, position int, turn_hash string")
    return repairs.repaired(spark.createDataFrame(statements, SAID), spark.createDataFrame(repairs_, MADE), turns)


def test_repairs_meet_statements_in_the_order_made(spark):
    # the same is said twice at turn 2: one repair takes the first, the next one the second, a third finds nothing
    rows, applied = merged(spark, [said(1, 1, "calm"), said(2, 2, "ill", position=20), said(3, 2, "ILL", position=21), said(4, 4, "well")],
        [made(11, "fact_retract", 2, "ill"), made(12, "fact_correct", 2, "Ill", "tired"), made(13, "fact_retract", 2, "ill"), made(14, "fact_correct", 4, "well", "asleep", 9),
         made(15, "fact_retract", 4, "well"), made(16, "fact_restore", 1, "calm", turn_hash="h1"), made(17, "fact_restore", 1, "angry", turn_hash="h1"), made(18, "fact_restore", 1, "sad", turn_hash="old")])
    got = {(r.id, r.position, r.turn, r.value, r.owner) for r in rows.collect()}
    assert got == {(1, 10, 1, "calm", False), (-12, 21, 2, "tired", True), (-14, 59, 9, "asleep", True), (-17, 19, 1, "angry", True)}
    assert {r.repair_id: r.id for r in applied.collect()} == {11: 2, 12: 3, 13: None, 14: 4, 15: 4, 16: 1, 17: -17, 18: None}


def test_a_correction_of_what_accumulates_stands_in_place(spark):
    rows, _ = merged(spark, [said(1, 1, "brave", "has_trait")], [made(11, "fact_correct", 1, "brave", "bold", 4, predicate="has_trait")])
    assert [(r.id, r.turn, r.value) for r in rows.collect()] == [(-11, 1, "bold")]


LOCK = "conv_id int, lock_id bigint, seq int, target_repair bigint, turn int, subject string, subject_type string, predicate string, object string, object_type string, value string, polarity string"


def test_locks_hold_off_what_would_change_them(spark):
    rows, _ = merged(spark, [said(1, -1, "king", position=-1), said(2, 1, "king"), said(3, 2, "beggar"), said(4, 3, "lost", subject="Bo")], [made(11, "fact_correct", 9, "none", "x")])
    locks = spark.createDataFrame([(1, 91, 1, None, -1, "ann", "character", "has_status", None, None, "King", "positive"), (1, 92, 2, None, -1, "ann", None, "has_status", None, None, "king", None)], LOCK)
    kept, off = repairs.held_off(repairs.locked(rows, locks))
    assert {r.id for r in kept.collect()} == {1, 4} and [(r.lock_id, r.id) for r in off.collect()] == [(91, 3)]
    done = folds.versions(kept.selectExpr("*", "'narration' AS source", "'actual' AS modality")).collect()
    assert {r.id: r.outcome for r in done} == {1: "current", 4: "current"}


def test_a_locked_tie_is_changed_in_its_direction_or_both_ways(spark):
    tie = lambda i, turn, value, a, b: said(i, turn, value, "relationship", a, b)
    rows, _ = merged(spark, [tie(1, -1, "teacher of", "Ann", "Bo"), tie(2, 1, "pupil of", "Bo", "Ann"), tie(3, 2, "hater of", "Ann", "Bo"), tie(4, 3, "friends", "Bo", "Ann")], [made(11, "fact_retract", 9, "none")])
    locks = spark.createDataFrame([(1, 91, 1, None, -1, "Ann", "character", "relationship", "Bo", None, "teacher of", "positive")], LOCK)
    kept, off = repairs.held_off(repairs.locked(rows, locks))
    assert {r.id for r in kept.collect()} == {1, 2} and {r.id for r in off.collect()} == {3, 4}


def test_thread_states(spark):
    o = spark.createDataFrame([(1, 1, 1)], "conv_id int, thread_id int, turn int")
    c = spark.createDataFrame([(1, 1, 3, "fulfilled"), (1, 1, 4, "fulfilled"), (1, 1, 7, "fulfilled")], "conv_id int, thread_id int, turn int, outcome string")
    e = spark.createDataFrame([(1, 1, 5, 1, "thread_reopen", None), (1, 1, 6, 2, "thread_reopen", None), (1, 1, 9, 3, "thread_close", "dropped")], "conv_id int, thread_id int, turn int, seq int, kind string, outcome string")
    got = [(r.turn, r.status, r.by_owner, r["last"]) for r in repairs.thread_states(o, c, e).orderBy("turn").collect()]
    assert got == [(1, "open", False, False), (3, "fulfilled", False, False), (5, "open", True, False), (7, "fulfilled", False, True)]


def test_an_edit_takes_one_scene_and_its_stories_out_of_force(spark):
    w = lambda edited: spark.createDataFrame([(1, i, [f"m{2 * i}", f"m{2 * i + 1}" + ("*" if i == edited else "")]) for i in range(4)], "conv_id int, window int, members array<string>")
    scenes = w(None).select("conv_id", stories.members_key(F.col("members")).alias("key")).orderBy("window").collect()
    made_ = spark.createDataFrame([(1, s.key, f"s{i}", g, i, a) for i, s in enumerate(scenes) for g, a in (("old", 1), ("new", 2)) if not (g == "new" and i == 1)], "conv_id int, key string, scene_id string, generation string, created_at int, activated_at int")
    told = spark.createDataFrame([(1, f"t{m}", [f"s{i}" for i in range(m)], "new", m, 2) for m in range(5)] + [(1, "u", ["s0", "s1", "s2", "s3"], "old", 9, 1)], "conv_id int, story_id string, members array<string>, generation string, created_at int, activated_at int")
    for edited, left, story in ((None, {0, 1, 2, 3}, "t4"), (2, {0, 1, 3}, "t2"), (0, {1, 2, 3}, None)):
        now = stories.current_scenes(w(edited), made_, "new")
        assert {r.window for r in now.collect()} == left
        best = stories.current_story(told, now, "new")
        assert [r.story_id for r in best.collect()] == ([] if story is None else [story])
        want = [] if edited is None else [("scene", edited)]
        assert [(r.kind, r.window) for r in stories.schedule(w(edited), now, best).collect()] == want
    partial = stories.current_story(told.filter("story_id = 't2'"), stories.current_scenes(w(None), made_, "new"), "new")
    assert [(r.kind, r.window) for r in stories.schedule(w(None), stories.current_scenes(w(None), made_, "new"), partial).collect()] == [("story", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_appends_equal_the_whole_way(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(25):
        for p in range(rng.randint(1, 14)):
            rows.append((conv, p, f"h{conv}.{p}", rng.choice(["user", "char", "char", "user", "char"]), rng.choice([None, None, None, "true", "allBefore" if p < 3 else None]), rng.random() < 0.1, f"r{p}"))
    schema = "conv_id int, position int, rev_hash string, role string, disabled string, is_comment boolean, rev_id string"
    upto = {conv: [rng.randint(3, 8), rng.randint(8, 11), 99] for conv in range(25)}
    cut = lambda k: spark.createDataFrame([r for r in rows if r[1] < upto[r[0]][k]], schema)
    state = ledger.chain_state(cut(0))
    for k in (1, 2):
        got, state = ledger.appended(state, cut(k).drop("rev_id"))
        whole = {(r.conv_id, r.position): (r.turn, r.turn_hash) for r in ledger.with_turns(cut(k)).collect()}
        before = {(r.conv_id, r.position) for r in cut(k - 1).collect()}
        assert {(r.conv_id, r.position): (r.turn, r.turn_hash) for r in got.collect()} == {p: t for p, t in whole.items() if p not in before}
        full = {r.conv_id: (r.n, r.chain, r.turn, r.last_user, r.tail) for r in ledger.chain_state(cut(k)).collect()}
        grown = {p[0] for p in whole if p not in before}
        assert {r.conv_id: (r.n, r.chain, r.turn, r.last_user, r.tail) for r in state.collect()} == {c: s for c, s in full.items() if c in grown}
        # chats that did not grow keep the state that they had
        state = spark.createDataFrame(ledger.chain_state(cut(k)).collect(), state.schema)


def test_an_edit_or_a_cut_is_no_append(spark):
    schema = "conv_id int, position int, rev_hash string, role string, disabled string, is_comment boolean"
    old = spark.createDataFrame([(c, p, f"h{p}", "user" if p % 2 == 0 else "char", None, False) for c in (1, 2, 3) for p in range(3)], schema)
    new = spark.createDataFrame([(c, p, "edited" if (c, p) == (1, 1) else f"h{p}", "user" if p % 2 == 0 else "char", "allBefore" if (c, p) == (2, 4) else None, False) for c in (1, 2, 3) for p in range(5)], schema)
    rows, _ = ledger.appended(ledger.chain_state(old), new)
    assert {(r.conv_id, r.position) for r in rows.collect()} == {(3, 3), (3, 4)}


def test_compaction_rebuilds_every_observation(spark):
    from sagaledger.operators import compaction

    rng = random.Random(4)
    rows = []
    for conv in range(5):
        entries = [f"a{i}" for i in range(rng.randint(0, 12))]
        for k in range(rng.randint(1, 15)):
            rows.append((conv, k, list(entries)))
            for _ in range(rng.choice([0, 1, 1, 4])):
                if entries and rng.random() < 0.6:
                    entries[rng.randrange(len(entries))] = rng.choice([f"x{k}", None])
                elif rng.random() < 0.5:
                    entries.append(f"n{k}")
                else:
                    entries = entries[:-1]
    obs = spark.createDataFrame(rows, "conv_id int, obs_id int, entries array<string>")
    got = held_rows = compaction.compacted(obs).collect()
    want, base = set(), {}
    for conv, k, e in rows:
        b = base.get(conv)
        diff = 0 if b is None else sum(i >= len(b[1]) or b[1][i] != x for i, x in enumerate(e))
        if b is None or diff > 0.25 * max(1, len(e)):
            base[conv] = (k, e)
            want.add((conv, k, None, None))
        else:
            want.add((conv, k, b[0], diff))
    assert {(r.conv_id, r.obs_id, r.base_id, None if r.changed is None else len(r.changed)) for r in got} == want
    back = compaction.rebuilt(compaction.compacted(obs))
    assert {(r.conv_id, r.obs_id): r.entries for r in back.collect()} == {(c, k): e for c, k, e in rows}
    assert len(held_rows) == len(rows)


def test_compaction_sends_no_manifests_to_the_driver(spark):
    from sagaledger.operators import compaction

    obs = spark.range(6).selectExpr("1 AS conv_id", "id AS obs_id", "transform(sequence(0, 7), i -> IF(i % 2 = 0 AND id >= 3, 'x', 'a') || i) AS entries")
    rows = compaction.compacted(obs)
    for made in (rows, compaction.rebuilt(rows)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.obs_id, r.base_id) for r in rows.collect()} == {(0, None), (1, 0), (2, 0), (3, None), (4, 3), (5, 3)} and compaction.rebuilt(rows).exceptAll(obs).isEmpty()


def variants_by_hand(names, persona, marked, text):
    """Request by request and name by name."""
    import re

    from sagaledger.functions.text import name_norm
    from sagaledger.operators.variants import FAMILY, name_keys, word_keys

    given = lambda n: n[1:] if len(n) == 3 and n[0] in FAMILY and re.fullmatch("[가-힣]+", n) else None
    own = [(i, t, name_norm(n), p) for i, t, n, p in names]
    persona = {name_norm(n) for n in persona}
    held = {n for _, _, n, _ in own}
    own += [(f"mark:{n}", "character", n, False) for n in {name_norm(m) for m in marked} - held - persona]
    taken = {n for _, _, n, _ in own} | persona | {given(n) for n in persona}
    people = [(i, n) for i, t, n, p in own if t == "character" and not p]
    owners = {}
    for i, n in people:
        if given(n):
            owners.setdefault(given(n), set()).add(i)
    for run in set(re.findall("[가-힣]+", text)):
        for size in (4, 3, 2):
            found = {i for i, n in people if len(run) >= size and set(name_keys(n)) & set(word_keys(run[:size]))}
            if found:
                owners.setdefault(run[:size], set()).update(found)
                break
    return {(next(iter(ids)), w) for w, ids in owners.items() if len(ids) == 1 and w not in taken}


def test_name_variants(spark):
    from sagaledger.operators import variants

    assert variants.folded("Ha-jin") == "hajin" and set(variants.word_keys("하진")) == {"hajin"} and "bargsujin" in variants.word_keys("박수진") and "bagsujin" in variants.word_keys("박수진")
    names = [("1", "character", "백이안", False), ("2", "character", "Hajin", False), ("3", "character", "Park Soo-jin", False), ("4", "character", "김하진", False), ("5", "place", "서울", False), ("6", "character", "이서윤", True), ("7", "character", "최서울", False), ("8", "character", "Minho", False)]
    asked = [(1, "하진이 왔다. 이안은 박수진을 봤다", ["이서윤"], []), (2, "수진에게 민호가", ["오민호"], ["정다은", "백이안"]), (3, "nothing in Hangul", [], ["Jihoon"]), (4, "지훈은 서윤과", ["서윤"], ["Jihoon"])]
    entities = spark.createDataFrame([(1, *n) for n in names], "conv_id int, entity_id string, type string, name string, persona boolean")
    requests = spark.createDataFrame([(r, 1, t, p, m) for r, t, p, m in asked], "request_id int, conv_id int, text string, persona_names array<string>, marked array<string>")
    got = {}
    for r in variants.variants(requests, entities).collect():
        got.setdefault(r.request_id, set()).add((r.entity_id, r.variant))
    assert got == {r: w for r, t, p, m in asked if (w := variants_by_hand(names, p, m, t))}
    assert ("1", "이안") in got[1] and ("3", "박수진") in got[1] and not any(v == "하진" for _, v in got[1]), "two characters share a spelling"
    assert ("mark:jihoon", "지훈") in got[4]
