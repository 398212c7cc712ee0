"""The source ledger: manifests, bodies, the head and its turns, plans of change, replay.

Rows follow these shapes (extra columns are carried along or ignored):
    manifest    conv_id, observed_at, entries array<struct<object_id, rev_hash>>
    membership  conv_id, position, rev_id, rev_hash, role, disabled, is_comment, lifecycle
    ops         conv_id, seq, op, member, to, after
Everything is partitioned by conversation; no plan needs an order over all conversations.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import held
from ._grouped import fold_groups



def _off(disabled: Column) -> Column:
    return F.coalesce(disabled, F.lit("")).isin("true", "allBefore")


# ---------------------------------------------------------------- ingest


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """One row per listed message: conv_id, observed_at, position, object_id, rev_hash."""
    return manifests.select("conv_id", "observed_at", F.posexplode("entries").alias("position", "e")).select(
        "conv_id", "observed_at", "position", F.col("e.object_id").alias("object_id"), F.col("e.rev_hash").alias("rev_hash")
    )


def manifest_hash(rows: DataFrame) -> DataFrame:
    """(conv_id, manifest_hash): one hash of all (object_id, rev_hash) in order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "object_id", "rev_hash")))
    listed = F.transform(ordered, lambda e: F.struct(e["object_id"].alias("id"), e["rev_hash"].alias("hash")))
    return rows.groupBy("conv_id").agg(F.sha2(F.to_json(listed), 256).alias("manifest_hash"))


def newest_manifest(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("conv_id").agg(F.max_by(F.struct("observed_at", "entries"), "observed_at").alias("m")).select("conv_id", "m.*")


def revision_hash(role: Column, content: Column) -> Column:
    """Identity of a message version: a hash of its canonical JSON, keys in order."""
    return F.sha2(F.to_json(F.struct(content.alias("content"), role.alias("role"))), 256)


def checked_bodies(bodies: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, rejected) bodies: stored ones have the hash they claim and are not known yet; one row per version."""
    told = bodies.withColumn("_hash", revision_hash(F.col("role"), F.col("content")))
    rejected = told.filter(~F.col("_hash").eqNullSafe(F.col("rev_hash"))).drop("_hash")
    fresh = told.filter(F.col("_hash") == F.col("rev_hash")).drop("_hash").dropDuplicates(["object_id", "rev_hash"])
    return fresh.join(known.select("object_id", "rev_hash"), ["object_id", "rev_hash"], "left_anti"), rejected


def missing_bodies(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed versions that no store has."""
    return listed.select("conv_id", "object_id", "rev_hash").distinct().join(known, ["object_id", "rev_hash"], "left_anti")


def is_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """(conv_id, appended, start): whether the new manifest only adds messages behind the old one's."""
    pair = old.select("conv_id", "position", F.struct("object_id", "rev_hash").alias("o")).join(
        new.select("conv_id", "position", F.struct("object_id", "rev_hash").alias("n")), ["conv_id", "position"], "full")
    return pair.groupBy("conv_id").agg(
        F.bool_and(F.col("o").isNull() | F.col("o").eqNullSafe(F.col("n"))).alias("appended"), F.count("o").alias("start"))


def chain_state(members: DataFrame) -> DataFrame:
    """(conv_id, n, chain, turn, last_user, tail): all that an append needs of a chat's head, one row a chat.

    chain is a hash of the versions in order, turn the last visible turn (-1: none), last_user whether the last visible message
    is the user's, and tail the versions of the last turn and of the one before it, which later turn hashes hold.
    """
    rows = with_turns(members)
    by = Window.partitionBy("conv_id")
    last = F.max("turn").over(by)
    rows = rows.withColumn("_last", last)
    near = F.when(F.col("turn") >= F.col("_last") - 1, F.struct("position", "turn", "rev_hash"))
    seen = F.when(F.col("turn").isNotNull(), F.struct("position", (F.col("role") == "user").alias("user")))
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), chain_of(F.transform(F.array_sort(F.collect_list(F.struct("position", "rev_hash"))), lambda m: m["rev_hash"])).alias("chain"),
        F.coalesce(F.max("turn"), F.lit(-1)).cast("int").alias("turn"), F.max(seen)["user"].alias("last_user"), F.array_sort(F.collect_list(near)).alias("tail"))


def chain_of(hashes: Column, start: Column | None = None) -> Column:
    """A hash of hashes in order, from that of what stands before them."""
    return F.aggregate(hashes, F.lit("") if start is None else start, lambda at, h: F.sha2(F.concat(at, h), 256))


def appended(state: DataFrame, listed: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, state): the messages that a manifest adds behind a head, with turn and turn_hash, and the state after them.

    state: what chain_state() says of the heads.  listed: whole manifests, conv_id, position, rev_hash, role, disabled,
    is_comment.  A manifest whose first n versions give the head's chain is an append: then only its tail is laid out, from
    what the state carries, and no stored message is read.  Chats with a manifest that is no append, or whose tail hides what
    comes before it, are in neither; they take the full way (changes()).
    """
    if k != 1:
        raise ValueError("the state carries what turn hashes over one turn before need")
    known = listed.join(state, "conv_id")
    prefix = F.transform(F.array_sort(F.collect_list(F.when(F.col("position") < F.col("n"), F.struct("position", "rev_hash")))), lambda m: m["rev_hash"])
    cuts = F.bool_or((F.col("position") >= F.col("n")) & F.coalesce(F.col("disabled") == "allBefore", F.lit(False)))
    good = known.groupBy("conv_id", "chain").agg(prefix.alias("_p"), cuts.alias("_cut")).filter((chain_of(F.col("_p")) == F.col("chain")) & ~F.coalesce("_cut", F.lit(False))).select("conv_id")
    tail = known.join(good, "conv_id", "left_semi").filter(F.col("position") >= F.col("n"))
    inside = ~_off(F.col("disabled")) & ~F.coalesce("is_comment", F.lit(False))
    tail = tail.withColumn("_in", inside)
    by = Window.partitionBy("conv_id", "_in").orderBy("position")
    user = F.col("role") == "user"
    before = F.coalesce(F.lag(user).over(by), F.col("last_user"))
    opens = before.isNull() | (user & ~before)
    turn = F.col("turn") + F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = tail.withColumn("_turn", F.when(F.col("_in"), turn)).drop("turn").withColumnRenamed("_turn", "turn")
    # The turns that the tail touches or looks back on: those carried, and its own.
    old = state.join(good, "conv_id", "left_semi").select("conv_id", F.explode("tail").alias("m")).select("conv_id", "m.position", "m.turn", "m.rev_hash", F.lit(None).cast("string").alias("role"))
    both = old.unionByName(rows.filter("_in").select("conv_id", "position", F.col("turn").cast("int").alias("turn"), "rev_hash", "role"))
    each = both.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("position", "rev_hash"))).alias("m"), F.max_by(F.struct("position", "role"), "position").alias("anchor"))
    each = each.withColumn("s", F.array_join(F.transform("m", lambda x: x["rev_hash"]), ","))
    frame = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-k, 0)
    each = each.withColumn("window", F.array_join(F.collect_list("s").over(frame), "|"))
    hashes = each.filter("anchor.role IS NOT NULL AND anchor.role <> 'user'").select("conv_id", F.col("anchor.position").alias("position"), F.substring(F.sha2(F.concat(F.lit("turn\n"), "window"), 256), 1, 32).alias("turn_hash"))
    out = rows.join(hashes, ["conv_id", "position"], "left").select("conv_id", "position", "rev_hash", "role", F.col("turn").cast("int").alias("turn"), "turn_hash")
    more = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("_more"), F.transform(F.array_sort(F.collect_list(F.struct("position", "rev_hash"))), lambda m: m["rev_hash"]).alias("_h"),
        F.max("turn").cast("int").alias("_turn"), F.max(F.when(F.col("_in"), F.struct("position", (F.col("role") == "user").alias("user"))))["user"].alias("_user"),
        F.collect_list(F.when(F.col("_in"), F.struct("position", F.col("turn").cast("int").alias("turn"), "rev_hash"))).alias("_tail"))
    now = F.coalesce("_turn", "turn")
    last = F.array_sort(F.filter(F.concat("tail", "_tail"), lambda m: m["turn"] >= now - 1))
    after = state.join(more, "conv_id").select("conv_id", (F.col("n") + F.col("_more")).alias("n"), chain_of(F.col("_h"), F.col("chain")).alias("chain"), now.alias("turn"), F.coalesce("_user", "last_user").alias("last_user"), last.alias("tail"))
    return out, after


def idempotent(observations: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Provisional observations, each key once: the earliest stays."""
    first = Window.partitionBy(key).orderBy("observed_at", "conv_id")
    return observations.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


# ---------------------------------------------------------------- head and turns


def cut_position(members: DataFrame) -> Column:
    """The last position of a conversation that hides everything up to it; -1 without one."""
    at = F.max(F.when(F.col("disabled") == "allBefore", F.col("position"))).over(Window.partitionBy("conv_id"))
    return F.coalesce(at, F.lit(-1))


def head_view(members: DataFrame, upto: int | None = None, replies_only: bool = False) -> DataFrame:
    """Members that reads may use: behind the cut, accepted, not disabled, no comment, at most at position upto."""
    rows = members if upto is None else members.filter(F.col("position") <= upto)
    rows = rows.withColumn("_cut", cut_position(rows)).filter(
        (F.col("position") > F.col("_cut")) & ~_off(F.col("disabled")) & ~F.coalesce("is_comment", F.lit(False)) & (F.coalesce("lifecycle", F.lit("accepted")) == "accepted"))
    return (rows.filter("role <> 'user'") if replies_only else rows).drop("_cut")


def with_turns(members: DataFrame, k: int = 1) -> DataFrame:
    """members with turn and turn_hash.

    A turn is a run of user messages and the run of replies behind it; what comes before any user message is turn 0.
    Its anchor, the last reply, carries a hash of the turn's versions and of the k turns before it.
    """
    rows = members.withColumn("_cut", cut_position(members))
    inside = (F.col("position") > F.col("_cut")) & ~_off(F.col("disabled")) & ~F.coalesce("is_comment", F.lit(False))
    rows = rows.withColumn("_in", inside)
    by = Window.partitionBy("conv_id", "_in").orderBy("position")
    user = F.col("role") == "user"
    opens = F.lag(user).over(by).isNull() | (user & ~F.lag(user).over(by))
    turn = F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.withColumn("turn", F.when(F.col("_in"), turn))
    # Each turn once: its versions in order, its last member, then the k turns before it.
    each = rows.filter("_in").groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("position", "rev_hash"))).alias("m"), F.max_by(F.struct("position", "role"), "position").alias("anchor"))
    each = each.withColumn("s", F.array_join(F.transform("m", lambda x: x["rev_hash"]), ","))
    frame = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-k, 0)
    each = each.withColumn("window", F.array_join(F.collect_list("s").over(frame), "|")).filter("anchor.role <> 'user'")
    hashes = each.select("conv_id", F.col("anchor.position").alias("position"), F.substring(F.sha2(F.concat(F.lit("turn\n"), "window"), 256), 1, 32).alias("turn_hash"))
    return rows.join(hashes, ["conv_id", "position"], "left").drop("_cut", "_in")


def unit(turn: Column, position: Column) -> Column:
    """What a statement counts with: its turn, or itself alone."""
    return F.coalesce(turn, -1 - position)


def with_lifecycle(members: DataFrame) -> DataFrame:
    """members with the lifecycle that later messages give them: a reply is accepted once a user message follows it."""
    user = (F.col("role") == "user") & ~F.coalesce("is_comment", F.lit(False)) & ~F.coalesce(F.col("disabled") == "true", F.lit(False))
    later = F.max(user.cast("int")).over(Window.partitionBy("conv_id").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1))
    certain = (F.col("role") == "user") | F.coalesce("is_comment", F.lit(False)) | (F.coalesce(later, F.lit(0)) == 1)
    return members.withColumn("accepted", F.when(certain, "accepted").otherwise("provisional"))


def windows_due(turns: DataFrame, size: int = 8, lag: int = 4) -> DataFrame:
    """(conv_id, window, first_turn, last_turn, members): tumbling windows of turns that are followed by enough turns."""
    most = Window.partitionBy("conv_id")
    rows = turns.filter("turn is not null").withColumn("_due", F.floor((F.max("turn").over(most) + 1 - lag) / size))
    rows = rows.withColumn("window", F.floor(F.col("turn") / size)).filter("window < _due")
    return rows.groupBy("conv_id", "window").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "rev_id"))), lambda x: x["rev_id"]).alias("members"))


# ---------------------------------------------------------------- plans of change


def changes(head: DataFrame, manifest: DataFrame) -> DataFrame:
    """(conv_id, kind, object_id, position, old_hash, new_hash): how a manifest changes a head.

    Both sides have conv_id, position, object_id, rev_hash, role, disabled, swipe_id, generation_id.  A full outer join on
    the message's identity tells what left, came and changed; the tail replies of both sides in the same slot are a reroll.
    """
    fields = ("position", "rev_hash", "role", "disabled", "swipe_id", "generation_id")
    last = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    pick = lambda df, p: last(df).select("conv_id", "object_id", F.struct(*fields, "_n").alias(p))
    both = pick(head, "o").join(pick(manifest, "n"), ["conv_id", "object_id"], "full")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    gone, came = F.col("n").isNull(), F.col("o").isNull()
    tail_gone = gone & (o("position") == o("_n") - 1) & (o("role") == "char")
    tail_came = came & (n("position") == n("_n") - 1) & (n("role") == "char")
    per = Window.partitionBy("conv_id")
    old_tail = F.max(F.when(tail_gone, o("position"))).over(per)
    new_tail = F.max(F.when(tail_came, n("position"))).over(per)
    rows = both.withColumn("_reroll", old_tail.isNotNull() & old_tail.eqNullSafe(new_tail)).withColumn("_tail", F.when(tail_gone | tail_came, True))
    rows = rows.withColumn("_left", F.sum((gone & ~(F.col("_reroll") & F.coalesce("_tail", F.lit(False)))).cast("int")).over(per))
    rows = rows.withColumn("_came", F.sum(came.cast("int")).over(per)).withColumn("_old_n", F.max(o("_n")).over(per))
    paired = F.col("_reroll") & F.coalesce("_tail", F.lit(False))
    live = gone & F.coalesce("_tail", F.lit(False)) & (F.col("_left") == 1) & (F.col("_came") == 0)
    kind = (
        F.when(paired & came, "reroll")
        .when(paired & gone, F.lit(None))
        .when(gone, F.when(live, "reroll").otherwise("delete"))
        .when(came, F.when(n("position") >= F.coalesce(F.col("_old_n"), F.lit(0)) - F.col("_left") - F.col("_reroll").cast("int"), "append").otherwise("insert"))
        .when(o("rev_hash") == n("rev_hash"), F.lit(None))
        .when(~o("disabled").eqNullSafe(n("disabled")), "disable")
        .when(~o("swipe_id").eqNullSafe(n("swipe_id")), "swipe")
        .when((n("role") == "char") & ~o("generation_id").eqNullSafe(n("generation_id")), "continue")
        .otherwise("edit")
    )
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    return rows.select("conv_id", "kind", "object_id", F.coalesce(n("position"), o("position")).alias("position"), o("rev_hash").alias("old_hash"), n("rev_hash").alias("new_hash"))


def commit_reason(found: DataFrame, heads: DataFrame, most: float = 0.5) -> DataFrame:
    """(conv_id, reason, changes): null for pure appends, the one kind of change, or a reconciliation."""
    per = found.groupBy("conv_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "append", F.col("kind")))).alias("kinds"),
        F.count_if(F.col("kind").isin("delete", "reroll", "edit", "swipe", "continue", "disable")).alias("touched"),
        F.count(F.lit(1)).alias("changes"))
    size = heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    only = F.element_at("kinds", 1)
    reason = (
        F.when(F.col("touched") / F.greatest(F.col("n"), F.lit(1)) > most, "reconciliation")
        .when(F.size("kinds") == 0, F.lit(None))
        .when(F.size("kinds") > 1, "reconciliation")
        .when(only == "continue", "edit").when(only == "insert", "reconciliation").otherwise(only))
    return per.join(size, "conv_id", "left").select("conv_id", reason.alias("reason"), "changes")


def change_summary(found: DataFrame) -> DataFrame:
    """(conv_id, summary): kinds with their counts, most frequent first, then by name."""
    each = found.groupBy("conv_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("n") == 1, F.col("kind")).otherwise(F.concat("kind", F.lit(" ×"), "n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind", text.alias("text"))))
    return each.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), ", ").alias("summary"))


class Members:
    """A list of members as links from each to the one behind it, so that an op costs the same wherever it works."""

    def __init__(self) -> None:
        self.behind: dict[str | None, str | None] = {None: None}  # None stands for the place before the first and after the last
        self.before: dict[str | None, str | None] = {None: None}

    def _join(self, a: str | None, b: str | None) -> None:
        self.behind[a], self.before[b] = b, a

    def insert(self, member: str, after: str | None) -> None:
        follower = self.behind[after]
        self._join(after, member)
        self._join(member, follower)

    def remove(self, member: str) -> str | None:
        """Take a member out; what stood before it."""
        before = self.before.pop(member)
        self._join(before, self.behind.pop(member))
        return before

    def apply(self, op: dict) -> None:
        if op["op"] == "set":
            self.__init__()
            for member in op["members"]:
                self.insert(member, self.before[None])
        elif op["op"] == "remove":
            self.remove(op["member"])
        elif op["op"] == "replace":
            self.insert(op["to"], self.remove(op["member"]))
        elif op["op"] == "insert":
            self.insert(op["member"], op["after"])
        else:
            raise ValueError(f"unknown op {op['op']}")

    def __iter__(self) -> Iterator[str]:
        at = self.behind[None]
        while at is not None:
            yield at
            at = self.behind[at]


def replayed(members: list[str], ops: list[dict]) -> list[str]:
    """Members after the ops: set, remove, replace, insert behind another.  Members are distinct."""
    out = Members()
    for op in [{"op": "set", "members": members}, *ops]:
        out.apply(op)
    return list(out)


def membership_of(ops: DataFrame) -> DataFrame:
    """(conv_id, position, member) rebuilt from ops (conv_id, seq, op, member, to, after, members), one conversation a group."""

    def fold(key: tuple, group: list[dict]) -> list[dict]:
        return [{"conv_id": key[0], "position": i, "member": m} for i, m in enumerate(replayed([], group))]

    kind = dict(ops.dtypes)["conv_id"]
    return fold_groups(ops, ["conv_id"], ["seq"], fold, f"conv_id {kind}, position int, member string")


#: Rounds of ancestors(); each doubles how far a commit sees, so no chain of commits is longer.
ANCESTOR_ROUNDS = 62


def ancestors(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv_id, commit_id, least): the commits that a head descends from, itself included, each with the least position that
    the commits between it and the head changed, the head's included (null: none).

    commits: conv_id, commit_id, parent_id, changed; heads: conv_id, commit_id.  Commits branch, so the way up is followed by
    pointer doubling: in round k every commit knows its ancestor 2**k steps up and the least change on the way, and the found
    ones double.  As many rounds as a chain's length has binary digits, each of two joins on a commit's id.
    """
    jumps = held(commits.select("conv_id", "commit_id", F.col("parent_id").alias("up"), F.col("changed").alias("low")))
    found = held(heads.select("conv_id", "commit_id").distinct().join(commits.select("conv_id", "commit_id"), ["conv_id", "commit_id"]).withColumn("least", F.lit(None).cast(dict(jumps.dtypes)["low"])))
    for _ in range(ANCESTOR_ROUNDS):
        steps = jumps.filter("up IS NOT NULL")
        further = found.join(steps, ["conv_id", "commit_id"]).select("conv_id", F.col("up").alias("commit_id"), F.least("least", "low").alias("least"))
        further = further.join(commits.select("conv_id", "commit_id"), ["conv_id", "commit_id"], "left_semi")
        if further.isEmpty():
            return found
        found = held(found.unionByName(further))
        beyond = jumps.select("conv_id", F.col("commit_id").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        # A commit whose way ends within 2**k steps leads nowhere further.
        jumps = held(steps.join(beyond, ["conv_id", "up"]).select("conv_id", "commit_id", F.col("_up").alias("up"), F.least("low", "_low").alias("low")))
    raise ValueError("commits descend from themselves")


def prefix_intact(commits: DataFrame, heads: DataFrame, upto: int) -> DataFrame:
    """(conv_id, commit_id, intact): whether the head still shows the story up to a position as a commit did: it is the commit,
    or descends from it through commits that changed only later positions.

    commits: conv_id, commit_id, parent_id (null at a root), changed (the least position it changed; null for appends).  Heads:
    conv_id, commit_id.  A commit that the head does not descend from is not intact.
    """
    seen = ancestors(commits, heads).withColumn("intact", F.col("least").isNull() | (F.col("least") > upto))
    return commits.select("conv_id", "commit_id").join(seen.drop("least"), ["conv_id", "commit_id"], "left").withColumn("intact", F.coalesce("intact", F.lit(False)))


def positional_diff(base: Column, now: Column) -> Column:
    """What an array has to change in a base of the same meaning: (at, value) pairs; lengths may differ."""
    at = F.sequence(F.lit(0), F.greatest(F.size(now) - 1, F.lit(0)))
    pairs = F.transform(at, lambda i: F.struct(i.alias("at"), F.get(now, i).alias("value"), F.get(base, i).eqNullSafe(F.get(now, i)).alias("same")))
    return F.transform(F.filter(pairs, lambda p: ~p["same"] & (p["at"] < F.size(now))), lambda p: F.struct(p["at"].alias("at"), p["value"].alias("value")))


def apply_diff(base: Column, diff: Column, size: Column) -> Column:
    """The array that positional_diff came from."""
    at = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    one = lambda i: F.coalesce(F.get(F.filter(diff, lambda d: d["at"] == i), F.lit(0))["value"], F.get(base, i))
    return F.when(size == 0, F.slice(base, 1, 0)).otherwise(F.transform(at, one))


def without_conversations(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the given conversations, and how many rows each lost."""
    kept, counts = {}, None
    for name, rows in tables.items():
        kept[name] = rows.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")
        lost = rows.join(gone.select("conv_id").distinct(), "conv_id", "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = lost if counts is None else counts.unionByName(lost)
    return kept, counts


# ---------------------------------------------------------------- canon


def canon_applied(manifests: DataFrame, texts: DataFrame) -> DataFrame:
    """(conv_id, observed_at, entries): the newest setting manifest all of whose texts are there."""
    rows = manifests.select("conv_id", "observed_at", "entries", F.explode_outer(F.col("entries.hash")).alias("hash"))
    lacking = rows.join(texts.select("hash"), "hash", "left_anti").filter("hash is not null").select("conv_id", "observed_at").distinct()
    return newest_manifest(manifests.join(lacking, ["conv_id", "observed_at"], "left_anti"))


def canon_as_of(applied: DataFrame, at: Column) -> DataFrame:
    """(conv_id, entries): what was in force at a time."""
    return applied.filter(F.col("applied_at") <= at).groupBy("conv_id").agg(F.max_by("entries", "applied_at").alias("entries"))


def strip_note_blocks(text: Column) -> tuple[Column, Column]:
    """A text without earlier generated note blocks, and the turns these were made for."""
    block = r"(?s)\[Notes turn (\d+)\].*?\[/Notes\]\n?"
    return F.regexp_replace(text, block, ""), F.transform(F.regexp_extract_all(text, F.lit(block), 1), lambda t: t.cast("int"))


def in_context(prompt: list[str], chat: list[tuple[str, str]], anchor: int = 48, misses: int = 3) -> list[str]:
    """Ids of chat messages that stand in a prompt: newest first, each found by a middle piece, at or before the last find.

    Each message's anchor gets the places of the prompt that hold it; the messages then take the last place that is left to
    them, until so many in a row have none.
    """
    squash = lambda s: " ".join(s.split())
    parts = [squash(p) for p in prompt]

    def places(text: str) -> list[int]:
        middle = max(0, len(text) // 2 - anchor // 2)
        piece = text[middle : middle + anchor]
        return [i for i, part in enumerate(parts) if piece and piece in part]

    found, limit, row = [], len(parts), 0
    for id_, text in reversed(chat):
        held = places(squash(text))
        left = held[: bisect_left(held, limit)]
        row = 0 if left else row + 1
        if row == misses:
            break
        if left:
            found.append(id_)
            limit = left[-1] + 1
    return found


def in_context_rows(requests: DataFrame) -> DataFrame:
    """(request_id, object_id) for requests (request_id, prompt array<string>, chat array<struct<object_id, text>>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.request_id, i) for r in pdf.itertuples() for i in in_context(list(r.prompt), [(c["object_id"], c["text"]) for c in r.chat])]
            yield pd.DataFrame(rows, columns=["request_id", "object_id"])

    return requests.mapInPandas(run, f"request_id {dict(requests.dtypes)['request_id']}, object_id string")
