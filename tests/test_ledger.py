import random

from pyspark.sql import functions as F

from sagaledger.operators import ledger

FIELDS = "conv_id string, position int, object_id string, rev_hash string, role string, disabled string, swipe_id int, generation_id string, is_comment boolean, lifecycle string, rev_id string"


def head(spark, spec):
    """spec: (object, hash, role, disabled) in order."""
    return spark.createDataFrame([("c", i, o, h, role, d, 0, "g", False, "accepted", o + h) for i, (o, h, role, d) in enumerate(spec)], FIELDS)


def kinds(spark, old, new):
    return {(r.kind, r.object_id) for r in ledger.changes(head(spark, old), head(spark, new)).collect()}


def test_turns_follow_runs_of_users_and_replies(spark):
    m = head(spark, [("g", "0", "char", None), ("u", "1", "user", None), ("v", "2", "user", None), ("a", "3", "char", None), ("b", "4", "char", None), ("x", "5", "char", "true"), ("w", "6", "user", None)])
    got = {r.object_id: (r.turn, r.turn_hash is not None) for r in ledger.with_turns(m).collect()}
    assert got == {"g": (0, True), "u": (1, False), "v": (1, False), "a": (1, False), "b": (1, True), "x": (None, False), "w": (2, False)}


def test_an_edit_changes_the_hashes_of_its_turn_and_of_the_next(spark):
    spec = [(f"u{i//2}" if i % 2 == 0 else f"a{i//2}", str(i), "user" if i % 2 == 0 else "char", None) for i in range(8)]
    before = {r.object_id: r.turn_hash for r in ledger.with_turns(head(spark, spec)).collect()}
    spec[2] = ("u1", "edited", "user", None)
    after = {r.object_id: r.turn_hash for r in ledger.with_turns(head(spark, spec)).collect()}
    assert {k for k in before if before[k] != after[k]} == {"a1", "a2"}


def test_cut_hides_what_is_before_it(spark):
    m = head(spark, [("u", "1", "user", None), ("a", "2", "char", "allBefore"), ("v", "3", "user", None), ("b", "4", "char", "true")])
    assert [r.object_id for r in ledger.head_view(m).collect()] == ["v"]


def test_kinds_of_change(spark):
    base = [("u", "1", "user", None), ("a", "2", "char", None), ("v", "3", "user", None), ("b", "4", "char", None)]
    assert kinds(spark, base, [*base, ("w", "5", "user", None)]) == {("append", "w")}
    assert kinds(spark, base, [*base[:3], ("c", "9", "char", None)]) == {("reroll", "c")}
    assert kinds(spark, base, base[:3]) == {("reroll", "b")}
    assert kinds(spark, base, [base[0], *base[2:]]) == {("delete", "a")}
    assert kinds(spark, base, [("u", "1x", "user", None), *base[1:]]) == {("edit", "u")}
    assert kinds(spark, base, [base[0], ("a", "2d", "char", "true"), *base[2:]]) == {("disable", "a")}
    assert kinds(spark, base, [base[0], ("n", "8", "user", None), *base[1:]]) == {("insert", "n")}
    assert kinds(spark, base, base) == set()


def test_acceptance(spark):
    m = head(spark, [("a", "1", "char", None), ("u", "2", "user", None), ("b", "3", "char", None)])
    assert [r.accepted for r in ledger.with_lifecycle(m).orderBy("position").collect()] == ["accepted", "accepted", "provisional"]


def test_replay_of_random_edits(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for c in range(5):
        members: list[str] = []
        for seq in range(40):
            kind = rng.choice(["insert", "insert", "remove", "replace"]) if members else "insert"
            if kind == "insert":
                at = rng.randrange(len(members) + 1)
                rows.append((f"c{c}", seq, kind, f"m{seq}", None, members[at - 1] if at else None, None))
                members.insert(at, f"m{seq}")
            elif kind == "remove":
                m = rng.choice(members)
                rows.append((f"c{c}", seq, kind, m, None, None, None))
                members.remove(m)
            else:
                m = rng.choice(members)
                rows.append((f"c{c}", seq, kind, m, None, None, None))
                rows[-1] = (f"c{c}", seq, "remove", m, None, None, None)
                members.remove(m)
        want[f"c{c}"] = members
    ops = spark.createDataFrame(rows, "conv_id string, seq int, op string, member string, to string, after string, members array<string>")
    got = ledger.membership_of(ops).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "member"))).alias("m")).collect()
    assert {r.conv_id: [x.member for x in r.m] for r in got} == {k: v for k, v in want.items() if v}


def test_bodies_are_checked_and_stored_once(spark):
    b = spark.createDataFrame([("o", "user", "hi"), ("o", "user", "hi"), ("p", "user", "bad")], "object_id string, role string, content string")
    b = b.withColumn("rev_hash", F.when(F.col("object_id") == "p", F.lit("x")).otherwise(ledger.revision_hash(F.col("role"), F.col("content"))))
    stored, rejected = ledger.checked_bodies(b, b.limit(0).select("object_id", "rev_hash"))
    assert stored.count() == 1 and rejected.count() == 1
    again, _ = ledger.checked_bodies(b, stored)
    assert again.count() == 0


def test_diff_rebuilds_what_it_came_from(spark):
    rng = random.Random(2)
    data = [([rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("abc") for _ in range(rng.randrange(6))]) for _ in range(40)]
    df = spark.createDataFrame(data, "base array<string>, now array<string>").withColumn("d", ledger.positional_diff(F.col("base"), F.col("now")))
    assert all(r.x == r.now for r in df.withColumn("x", ledger.apply_diff(F.col("base"), F.col("d"), F.size("now"))).collect())


def test_in_context_walks_back_and_stops():
    prompt = ["system", "first message here", "second message here", "third message here"]
    chat = [("0", "never sent"), ("1", "first message here"), ("2", "second message here"), ("3", "third message here")]
    assert ledger.in_context(prompt, chat) == ["3", "2", "1"]
