"""Queries over histories that branch, are repaired, or grow: ancestry, owners' repairs and locks, stories, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compaction, folds, ledger, repairs, stories, variants
from ..sources.tables import messages, table
from .catalog import HEAD, query

# ---------------------------------------------------------------- ancestry


@query("o68_branching_history", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_type = 'error' THEN floor(value) ELSE 1e9 END AS changed FROM events),
p AS (SELECT *, CASE WHEN k > 3 AND k % 5 = 0 THEN k - 3 WHEN k > 1 THEN k - 1 END AS up FROM e),
r AS (SELECT user_id, max(k) AS k, 1e9::DOUBLE AS least FROM e GROUP BY 1 UNION ALL SELECT r.user_id, p.up, least(r.least, p.changed) FROM r JOIN p ON p.user_id = r.user_id AND p.k = r.k WHERE p.up IS NOT NULL)
SELECT p.user_id AS conv_id, p.event_id AS commit_id, coalesce(r.least > 50, false) AS intact FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.k = p.k""")
def branching_history(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth commit goes back to the one three before it, so two commits of five end in side branches."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    back = F.when(F.row_number().over(by) % 5 == 0, F.lag("event_id", 3).over(by)).otherwise(F.lag("event_id").over(by))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("commit_id"), back.alias("parent_id"), F.when(F.col("event_type") == "error", F.floor("value")).alias("changed"))
    heads = rows.groupBy("conv_id").agg(F.max("commit_id").alias("commit_id"))
    return ledger.prefix_intact(rows, heads, 50)


# ---------------------------------------------------------------- repairs and locks


def _merged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as statements about their customers, merged with repairs that the turn's number decides: retracted, corrected in
    place, corrected from two turns later, restored as something new, restored as what is there.  Of the later corrections those
    of odd turns are locked."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    none = F.lit(None).cast("string")
    said = o.select(
        F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("turn"), F.row_number().over(w).alias("position"), F.lit("customer").alias("subject"),
        F.lit("character").alias("subject_type"), F.lit("has_status").alias("predicate"), none.alias("object"), none.alias("object_type"), F.col("o_orderstatus").alias("value"), F.lit("positive").alias("polarity"))
    kinds = F.element_at(F.create_map(*[x for k, v in {1: "fact_retract", 2: "fact_correct", 3: "fact_correct", 4: "fact_restore", 5: "fact_restore"}.items() for x in (F.lit(k), F.lit(v))]), F.col("turn") % 11)
    m = F.col("turn") % 11
    owner = said.filter(m.between(1, 5)).withColumns({
        "repair_id": F.col("id") + 1, "seq": F.col("id"), "kind": kinds, "value": F.when(m == 4, "R").otherwise(F.col("value")),
        "new_value": F.when(m == 2, "X").when(m == 3, "Y"), "from_turn": F.when(m == 3, F.col("turn") + 2), "turn_hash": F.lit("h")})
    turns = said.select("conv_id", "turn", "position", F.lit("h").alias("turn_hash"))
    rows, _ = repairs.repaired(said, owner, turns)
    locks = owner.filter((m == 3) & (F.col("turn") % 2 == 1)).select("conv_id", F.col("repair_id").alias("lock_id"), "seq", F.col("repair_id").alias("target_repair"), "turn", *repairs.STATED)
    return repairs.held_off(repairs.locked(rows, locks))


MERGED = """WITH s AS (SELECT o_custkey AS c, o_orderkey AS id, o_orderstatus AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
e AS (SELECT c, id, t, t AS p, 0 AS owner, 0 AS seq, v, false AS locked FROM s WHERE t % 11 NOT IN (1, 2)
    UNION ALL SELECT c, -id - 1, t, t, 1, id, 'X', false FROM s WHERE t % 11 = 2 UNION ALL SELECT c, -id - 1, t + 2, least(t + 2, n), 1, id, 'Y', t % 2 = 1 FROM s WHERE t % 11 = 3
    UNION ALL SELECT c, -id - 1, t, t, 1, id, 'R', false FROM s WHERE t % 11 = 4),
l AS (SELECT *, last_value(CASE WHEN locked THEN {'id': -id, 'v': v} END IGNORE NULLS) OVER (PARTITION BY c ORDER BY p, owner, seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lock FROM e)
"""


@query("o63_repaired_versions", MERGED + """SELECT c AS conv_id, id, CASE WHEN lead(1) OVER w IS NULL THEN 'current' ELSE 'superseded' END AS outcome, CAST(lead(t) OVER w AS INT) AS closed_turn
FROM l WHERE locked OR lock IS NULL WINDOW w AS (PARTITION BY c ORDER BY p, owner, seq, id)""")
def repaired_versions(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = _merged(spark, sf)
    return folds.versions(kept.withColumns({"source": F.lit("narration"), "modality": F.lit("actual")})).select("conv_id", "id", "outcome", "closed_turn")


@query("o62_held_off", MERGED + "SELECT c AS conv_id, lock.id AS lock_id, id FROM l WHERE NOT locked AND lock IS NOT NULL AND v <> lock.v")
def held_off(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)[1].select("conv_id", "lock_id", "id")


@query("o63_thread_events", """WITH e AS (SELECT l_orderkey AS k, l_linenumber + 1 AS turn, l_returnflag AS f, l_linenumber AS n FROM lineitem),
u AS (SELECT DISTINCT k, 1 AS turn, 'open' AS status, 0 AS side, 0 AS seq FROM e UNION ALL SELECT k, turn, 'fulfilled', 1, 0 FROM e WHERE f = 'R'
    UNION ALL SELECT k, turn, 'open', 2, n FROM e WHERE f = 'A' UNION ALL SELECT k, turn, 'dropped', 2, n FROM e WHERE f = 'N' AND n % 3 = 0),
w AS (SELECT *, lag(status = 'open') OVER (PARTITION BY k ORDER BY turn, side, seq, status) AS was FROM u), c AS (SELECT * FROM w WHERE was IS NULL OR was <> (status = 'open'))
SELECT k AS thread_id, turn, status, side = 2 AS by_owner, lead(1) OVER (PARTITION BY k ORDER BY turn, side, seq, status) IS NULL AS last FROM c""")
def thread_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("conv_id"), F.col("l_orderkey").alias("thread_id"), (F.col("l_linenumber") + 1).alias("turn"), "l_returnflag", F.col("l_linenumber").alias("seq"))
    owner = e.filter("l_returnflag = 'A' OR (l_returnflag = 'N' AND seq % 3 = 0)").withColumns({"kind": F.when(F.col("l_returnflag") == "A", "thread_reopen").otherwise("thread_close"), "outcome": F.lit("dropped")})
    opened = e.select("conv_id", "thread_id", F.lit(1).alias("turn")).distinct()
    return repairs.thread_states(opened, e.filter("l_returnflag = 'R'").withColumn("outcome", F.lit("fulfilled")), owner).drop("conv_id")


@query("o63_exclusions", """SELECT o_custkey AS conv_id, o_orderstatus AS entity, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'memory' ELSE 'cast' END AS scope,
    coalesce(min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END), min(o_orderkey)) AS repair_id FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2""")
def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    asked = o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("conv_id"), F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("  x")).alias("name"), F.when(F.col("o_orderpriority") == "1-URGENT", "memory").alias("scope"), F.col("o_orderkey").alias("repair_id"), F.col("o_orderkey").alias("seq"), F.lit("entity_exclude").alias("kind"))
    names = o.select(F.col("o_custkey").alias("conv_id"), F.concat(F.lower("o_orderstatus"), F.lit(" X")).alias("name"), F.col("o_orderstatus").alias("entity")).distinct()
    return repairs.exclusions(asked, names)


# ---------------------------------------------------------------- stories


def _edited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of one turn before and after an edit of the message at position 3 of every second conversation, and scenes of the
    former."""
    was = ledger.with_turns(messages(spark, sf))
    now = was.withColumn("rev_id", F.when((F.col("position") == 3) & (F.col("conv_id") % 2 == 0), F.concat("rev_id", F.lit("*"))).otherwise(F.col("rev_id")))
    old, new = ledger.windows_due(was, size=1, lag=0), ledger.windows_due(now, size=1, lag=0)
    scenes = old.select("conv_id", stories.members_key(F.col("members")).alias("key"), F.concat_ws("/", "conv_id", "window").alias("scene_id"), F.lit("g").alias("generation"), F.col("window").alias("created_at"), F.lit(0).alias("activated_at"), "window")
    return new, scenes, old


WINDOWS = HEAD + """, w AS (SELECT conv_id, turn AS "window", bool_or(position = 3 AND conv_id % 2 = 0) AS edited FROM turns GROUP BY 1, 2)
"""


@query("o69_current_scenes", WINDOWS + """SELECT conv_id, "window", conv_id || '/' || "window" AS scene_id FROM w WHERE NOT edited""")
def current_scenes(spark: SparkSession, sf: str) -> DataFrame:
    new, scenes, _ = _edited(spark, sf)
    return stories.current_scenes(new, scenes.drop("window"), "g").select("conv_id", F.col("window").cast("bigint").alias("window"), "scene_id")


def _story(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A story was written each time a window had its scene, of all scenes so far."""
    new, scenes, _ = _edited(spark, sf)
    sofar = Window.partitionBy("conv_id").orderBy("window")
    told = scenes.select("conv_id", F.concat_ws("#", "conv_id", F.row_number().over(sofar)).alias("story_id"), F.collect_list("scene_id").over(sofar).alias("members"), "generation", "created_at", "activated_at")
    current = stories.current_scenes(new, scenes.drop("window"), "g")
    return new, current, stories.current_story(told, current, "g")


@query("o69_current_story", WINDOWS + """, m AS (SELECT *, row_number() OVER x AS m, bool_or(edited) OVER x AS broken FROM w WINDOW x AS (PARTITION BY conv_id ORDER BY "window"))
SELECT conv_id, conv_id || '#' || max(m) AS story_id, max(m) AS scenes FROM m WHERE NOT broken GROUP BY 1""")
def current_story(spark: SparkSession, sf: str) -> DataFrame:
    return _story(spark, sf)[2]


@query("o69_schedule", WINDOWS + """SELECT conv_id, 'scene' AS kind, CAST("window" AS BIGINT) AS "window" FROM w WHERE edited""")
def schedule(spark: SparkSession, sf: str) -> DataFrame:
    return stories.schedule(*_story(spark, sf)).withColumn("window", F.col("window").cast("bigint"))


# ---------------------------------------------------------------- appends


@query("o03_append_tail", HEAD + """, z AS (SELECT conv_id, CAST(floor(count(*) * 0.6) AS INT) AS cut FROM head GROUP BY 1), ok AS (SELECT conv_id, cut FROM z WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.conv_id = z.conv_id AND h.disabled = 'allBefore' AND h.position >= cut) AND cut > 0),
each AS (SELECT conv_id, turn, string_agg(rev_hash, ',' ORDER BY position) AS s, max(position) AS anchor, arg_max(role, position) AS role FROM turns GROUP BY conv_id, turn),
framed AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY conv_id ORDER BY turn) || '|', '') || s AS win FROM each)
SELECT h.conv_id, h.position, t.turn, CASE WHEN f.role <> 'user' THEN substring(sha256('turn' || chr(10) || f.win), 1, 32) END AS turn_hash
FROM head h JOIN ok ON ok.conv_id = h.conv_id AND h.position >= ok.cut LEFT JOIN turns t ON t.conv_id = h.conv_id AND t.position = h.position LEFT JOIN framed f ON f.conv_id = t.conv_id AND f.turn = t.turn AND f.anchor = t.position""")
def append_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The first three fifths of every conversation are its head, and the whole is what is listed now."""
    m = messages(spark, sf).drop("text")
    n = F.floor(F.count(F.lit(1)).over(Window.partitionBy("conv_id")) * 0.6)
    state = ledger.chain_state(m.withColumn("_n", n).filter("position < _n").drop("_n"))
    rows, _ = ledger.appended(state, m.select("conv_id", "position", "rev_hash", "role", "disabled", "is_comment"))
    return rows.select("conv_id", "position", "turn", "turn_hash")


# ---------------------------------------------------------------- compaction and names


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """After each of a customer's orders the list of all so far, in which some priorities are replaced by the order's number."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    sofar = o.select(F.col("o_custkey").alias("conv_id"), F.row_number().over(w).alias("obs_id"), F.collect_list("o_orderpriority").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"))
    return sofar.select("conv_id", "obs_id", F.transform("p", lambda x, i: F.when((i % 4 == 0) & (F.floor(F.col("obs_id") / 3) % 2 == 1), F.floor(F.col("obs_id") / 3).cast("string")).otherwise(x)).alias("entries"))


@query("o71_compaction", """WITH RECURSIVE s AS (SELECT o_custkey AS c, row_number() OVER w AS k, array_agg(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
o AS (SELECT c, k, list_transform(p, lambda x, i: CASE WHEN (i - 1) % 4 = 0 AND k // 3 % 2 = 1 THEN CAST(k // 3 AS VARCHAR) ELSE x END) AS e FROM s),
d AS (SELECT a.c, a.k AS a, b.k AS b, len(list_filter(b.e, lambda x, i: a.e[i] IS DISTINCT FROM x)) AS n, len(b.e) AS m FROM o a JOIN o b ON a.c = b.c AND a.k < b.k),
nx AS (SELECT c, a, min(b) AS b FROM d WHERE n > 0.25 * m GROUP BY 1, 2), r AS (SELECT c, min(k) AS k FROM o GROUP BY 1 UNION ALL SELECT r.c, nx.b FROM r JOIN nx ON nx.c = r.c AND nx.a = r.k),
z AS (SELECT o.c, o.k, max(r.k) AS base FROM o JOIN r ON r.c = o.c AND r.k <= o.k GROUP BY 1, 2)
SELECT z.c AS conv_id, z.k AS obs_id, CASE WHEN base < z.k THEN base END AS base_id, CASE WHEN base < z.k THEN d.n END AS changed FROM z LEFT JOIN d ON d.c = z.c AND d.a = z.base AND d.b = z.k""")
def compaction_(spark: SparkSession, sf: str) -> DataFrame:
    rows = compaction.compacted(_observed(spark, sf))
    return rows.select("conv_id", F.col("obs_id").cast("bigint").alias("obs_id"), F.col("base_id").cast("bigint").alias("base_id"), F.size("changed").cast("bigint").alias("changed")).withColumn("changed", F.when(F.col("base_id").isNotNull(), F.col("changed")))


SYLLABLES = ("가", "나", "다", "라", "마", "바", "사", "자", "하", "고")


@query("o86_name_variants", """WITH c AS (SELECT c_nationkey AS n, c_custkey AS id, c_custkey // 2 % 100 AS d FROM customer), s AS (SELECT ['가', '나', '다', '라', '마', '바', '사', '자', '하', '고'] AS s)
SELECT n AS request_id, CAST(min(id) AS VARCHAR) AS entity_id, s[d // 10 + 1] || s[d % 10 + 1] AS variant FROM c, s GROUP BY n, d, s HAVING count(*) = 1""")
def name_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with even keys have full Korean names, the others names in Latin letters; each nation's message says all names."""
    from ..operators.entities import romanized

    c = table(spark, sf, "customer").withColumn("d", F.floor(F.col("c_custkey") / 2) % 100)
    two = lambda spelled: F.concat(*[F.element_at(F.array(*map(F.lit, spelled)), (digit + 1).cast("int")) for digit in (F.floor(F.col("d") / 10), F.col("d") % 10)])
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("백"), two(SYLLABLES))).otherwise(F.initcap(two([romanized(x) for x in SYLLABLES])))
    entities_ = c.select(F.col("c_nationkey").alias("conv_id"), F.col("c_custkey").alias("entity_id"), F.lit("character").alias("type"), name.alias("name"), F.lit(False).alias("persona"))
    none = F.array().cast("array<string>")
    words = c.select("c_nationkey", F.concat(two(SYLLABLES), F.lit("은")).alias("w")).groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("text"))
    return variants.variants(words.select(F.col("c_nationkey").alias("request_id"), F.col("c_nationkey").alias("conv_id"), "text", none.alias("persona_names"), none.alias("marked")), entities_)
