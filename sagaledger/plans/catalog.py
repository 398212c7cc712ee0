"""Registered queries: each applies an operator to whole driver tables, beside SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import coverage, entities, folds, ledger, memory, packing, retrieval, serving, state, views
from ..operators import recall as recall_
from ..sources.tables import messages, table
from .registry import Query, register

#: The head of every conversation as a WITH clause.
HEAD = """WITH head AS (
    SELECT conv_id, CAST(turn AS INT) AS position, role, text, sha256(text) AS rev_hash,
           CASE WHEN role = 'system' THEN 'allBefore' WHEN length(text) > 1500 THEN 'true' END AS disabled
    FROM conversations),
cut AS (SELECT conv_id, coalesce(max(CASE WHEN disabled = 'allBefore' THEN position END), -1) AS cut_at FROM head GROUP BY conv_id),
seen AS (SELECT h.* FROM head h JOIN cut c USING (conv_id) WHERE h.position > c.cut_at AND coalesce(h.disabled, '') NOT IN ('true', 'allBefore')),
marked AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR (role = 'user' AND lag(role) OVER w <> 'user') THEN 1 ELSE 0 END AS opens
           FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY position)),
turns AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY conv_id ORDER BY position) - 1 AS INT) AS turn FROM marked)
"""


def query(name: str, oracle: str | None = None):
    def wrap(f: Query) -> Query:
        register(name, f, oracle)
        return f

    return wrap


# ---------------------------------------------------------------- ledger


@query("o01_manifest_rows", "SELECT conv_id, CAST(turn AS INT) AS position, sha256(text) AS rev_hash FROM conversations")
def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("rev_id").alias("object_id"), "rev_hash"))), lambda e: F.struct(e["object_id"], e["rev_hash"]))
    lists = m.groupBy("conv_id").agg(F.lit("2024-01-01").cast("timestamp").alias("observed_at"), entries.alias("entries"))
    return ledger.manifest_rows(lists).select("conv_id", "position", "rev_hash")


@query("o02_stored_bodies", "SELECT sha256(text) AS rev_hash, count(*) AS rows FROM conversations GROUP BY 1")
def stored_bodies(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select(F.col("rev_id").alias("object_id"), "role", F.col("text").alias("content"), "rev_hash")
    told = m.withColumn("claimed", F.col("rev_hash")).withColumn("rev_hash", ledger.revision_hash(F.col("role"), F.col("content")))
    good, _ = ledger.checked_bodies(told, told.limit(0))
    return good.groupBy(F.col("claimed").alias("rev_hash")).agg(F.count(F.lit(1)).alias("rows"))


@query("o03_append_check", "SELECT conv_id, true AS appended, count(*) - 1 AS start FROM conversations GROUP BY conv_id")
def append_check(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select("conv_id", "position", F.col("rev_id").alias("object_id"), "rev_hash")
    last = F.max("position").over(Window.partitionBy("conv_id"))
    return ledger.is_append(m.withColumn("_l", last).filter("position < _l").drop("_l"), m)


@query("o09_conversation_list", """SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS users, sum(length(text)) AS chars,
    max(turn) AS last_position FROM conversations GROUP BY conv_id""")
def conversation_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("users"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.max("turn").alias("last_position"))


@query("o10_head_filter", HEAD + "SELECT conv_id, position, role, rev_hash FROM seen")
def head_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.head_view(messages(spark, sf)).select("conv_id", "position", "role", "rev_hash")


@query("o11_cut", HEAD + "SELECT conv_id, cut_at FROM cut")
def cut(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    return m.withColumn("cut_at", ledger.cut_position(m)).select("conv_id", "cut_at").distinct()


@query("o48_turn_layout", HEAD + """, each AS (
    SELECT conv_id, turn, string_agg(rev_hash, ',' ORDER BY position) AS s, max(position) AS anchor, arg_max(role, position) AS role FROM turns GROUP BY conv_id, turn),
framed AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY conv_id ORDER BY turn) || '|', '') || s AS win FROM each)
SELECT t.conv_id, t.position, t.turn, CASE WHEN f.role <> 'user' THEN substring(sha256('turn' || chr(10) || f.win), 1, 32) END AS turn_hash
FROM turns t LEFT JOIN framed f ON f.conv_id = t.conv_id AND f.turn = t.turn AND f.anchor = t.position""")
def turn_layout(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.with_turns(messages(spark, sf), k=1).filter("turn is not null").select("conv_id", "position", F.col("turn").cast("int").alias("turn"), "turn_hash")


@query("s05_acceptance", """SELECT conv_id, CAST(turn AS INT) AS position, CASE WHEN role = 'user' OR coalesce(max(CASE WHEN role = 'user' AND length(text) <= 1500 THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'accepted' ELSE 'provisional' END AS accepted FROM conversations""")
def acceptance(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.with_lifecycle(messages(spark, sf)).select("conv_id", "position", "accepted")


@query("o69_scene_windows", HEAD + """, most AS (SELECT conv_id, floor((max(turn) + 1 - 1) / 2.0) AS due FROM turns GROUP BY conv_id)
SELECT t.conv_id, CAST(floor(turn / 2.0) AS BIGINT) AS "window", min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n
FROM turns t JOIN most USING (conv_id) WHERE floor(turn / 2.0) < due GROUP BY 1, 2""")
def scene_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = ledger.windows_due(ledger.with_turns(messages(spark, sf)), size=2, lag=1)
    return w.select("conv_id", "window", F.col("first_turn").cast("int"), F.col("last_turn").cast("int"), F.size("members").cast("bigint").alias("n"))


def _changed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads, and manifests in which system messages are gone and long texts were cut."""
    m = messages(spark, sf).withColumn("object_id", F.col("rev_id")).withColumn("swipe_id", F.lit(0)).withColumn("generation_id", F.lit("g"))
    m = m.withColumn("disabled", F.lit(None).cast("string"))
    w = Window.partitionBy("conv_id").orderBy("position")
    new = m.filter("role <> 'system'").withColumn("position", F.row_number().over(w) - 1).withColumn("rev_hash", F.sha2(F.substring("text", 1, 800), 256))
    return m, new, ledger.changes(m, new)


CHANGED = """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'delete' WHEN length(text) > 800 THEN 'edit' END AS kind,
    role <> 'user' AND turn = max(turn) OVER (PARTITION BY conv_id) AS tail, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
"""


@query("o66_reconcile_plan", CHANGED + "SELECT conv_id, kind, count(*) AS rows FROM c WHERE kind IS NOT NULL GROUP BY 1, 2")
def reconcile_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf)[2].groupBy("conv_id", "kind").agg(F.count(F.lit(1)).alias("rows"))


@query("o66_commit_reason", CHANGED + """SELECT conv_id, count(*) AS changes, CASE WHEN count(*) > 0.5 * max(n) THEN 'reconciliation' WHEN count(DISTINCT kind) > 1 THEN 'reconciliation' ELSE min(kind) END AS reason
FROM c WHERE kind IS NOT NULL GROUP BY 1""")
def commit_reason(spark: SparkSession, sf: str) -> DataFrame:
    m, _, found = _changed(spark, sf)
    return ledger.commit_reason(found, m)


@query("o38_change_summary", CHANGED + """, k AS (SELECT conv_id, kind, count(*) AS n FROM c WHERE kind IS NOT NULL GROUP BY 1, 2)
SELECT conv_id, string_agg(CASE WHEN n = 1 THEN kind ELSE kind || ' ×' || n END, ', ' ORDER BY n DESC, kind) AS summary FROM k GROUP BY 1""")
def change_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.change_summary(_changed(spark, sf)[2])


@query("o67_membership_replay", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS position, conv_id || ':' || turn AS member FROM conversations WHERE role <> 'system'")
def membership_replay(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    w = Window.partitionBy("conv_id").orderBy("position")
    none = F.lit(None).cast("string")
    add = m.select("conv_id", F.col("position").alias("seq"), F.lit("insert").alias("op"), F.col("rev_id").alias("member"), none.alias("to"), F.lag("rev_id").over(w).alias("after"), F.lit(None).cast("array<string>").alias("members"))
    gone = m.filter("role = 'system'").select("conv_id", (F.col("position") + 1_000_000).alias("seq"), F.lit("remove").alias("op"), F.col("rev_id").alias("member"), none.alias("to"), none.alias("after"), F.lit(None).cast("array<string>").alias("members"))
    return ledger.membership_of(add.unionByName(gone))


@query("o68_prefix_intact", """SELECT user_id AS conv_id, event_id AS commit_id, coalesce(min(CASE WHEN event_type = 'error' THEN floor(value) END)
    OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 50, true) AS intact FROM events""")
def prefix_intact(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    parent = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    commits = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("commit_id"), parent.alias("parent_id"), F.when(F.col("event_type") == "error", F.floor("value")).alias("changed"))
    return ledger.prefix_intact(commits, commits.groupBy("conv_id").agg(F.max("commit_id").alias("commit_id")), 50)


@query("o71_observation_diff", """WITH l AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, CAST(len(list_filter(list_transform(range(1, greatest(len(string_split(text, ' ')), 1) + 1), lambda i: coalesce(string_split(before, ' ')[i], '') <> string_split(text, ' ')[i] OR len(string_split(before, ' ')) < i), lambda x: x)) AS INT) AS changed, true AS rebuilt FROM l WHERE before IS NOT NULL""")
def observation_diff(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("now"), F.lag(F.split("text", " ")).over(w).alias("base")).filter("base is not null")
    rows = rows.withColumn("d", ledger.positional_diff(F.col("base"), F.col("now")))
    return rows.select("conv_id", "turn", F.size("d").alias("changed"), (ledger.apply_diff(F.col("base"), F.col("d"), F.size("now")) == F.col("now")).alias("rebuilt"))


@query("o119_delete_conversation", "SELECT conv_id, count(*) AS rows FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1")
def delete_conversation(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    kept, _ = ledger.without_conversations({"message": m}, m.filter("role = 'system'"))
    return kept["message"].groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- joins and serving


@query("o21_star_join", """SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_join(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("o22_window_join", HEAD + """, h AS (SELECT conv_id, position, sha256(conv_id || ':' || position) AS th FROM seen)
SELECT conv_id, position, k.is_check FROM h, (VALUES (true), (false)) k(is_check)""")
def window_join(spark: SparkSession, sf: str) -> DataFrame:
    h = ledger.head_view(messages(spark, sf)).select("conv_id", "position", "rev_id", F.sha2("rev_id", 256).alias("turn_hash"))
    e = messages(spark, sf).select("rev_id", F.explode(F.array(F.sha2("rev_id", 256), F.concat(F.lit("reveal:"), F.sha2("rev_id", 256)))).alias("window_hash"))
    return serving.window_join(h, e).select("conv_id", "position", "is_check")


@query("o23_left_joined_coverage", "SELECT c_mktsegment, count(*) AS customers, count(o.n) AS with_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1")
def left_joined(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count("n").alias("with_orders"))


@query("o24_still_serving", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def still_serving(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return serving.still_serving(old, table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])


@query("o25_to_derive", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def to_derive(spark: SparkSession, sf: str) -> DataFrame:
    return serving.to_derive(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("o26_latest_before", """SELECT event_id, (SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts) AS previous
    FROM events e WHERE event_type = 'error'""")
def latest_before(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    new = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    old = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("id"))
    return serving.latest_before(new, old, ["user_id"], "ts").select("event_id", F.col("previous.id").alias("previous"))


@query("o27_as_of", """WITH s AS (SELECT user_id, event_type, event_id, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gone FROM events),
a AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, event_type, event_id FROM s JOIN a USING (user_id) WHERE ts <= t AND (gone IS NULL OR gone > t)""")
def as_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = e.select("user_id", "event_type", "event_id", F.col("ts").alias("created_at"), F.lead("ts").over(w).alias("discarded_at"))
    at = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"))
    return serving.as_of_many(at, rows, ["user_id"]).select("user_id", "event_type", "event_id")


@query("o28_current_members", HEAD + "SELECT conv_id, CAST(floor(turn / 2.0) AS BIGINT) AS \"window\" FROM turns JOIN (SELECT conv_id, floor(max(turn) / 2.0) AS due FROM turns GROUP BY 1) USING (conv_id) WHERE floor(turn / 2.0) < due GROUP BY 1, 2")
def current_members(spark: SparkSession, sf: str) -> DataFrame:
    w = ledger.windows_due(ledger.with_turns(messages(spark, sf)), size=2, lag=1)
    return serving.current_members(w, w.select("conv_id", "members")).select("conv_id", "window")


@query("o29_contained_members", "SELECT o_custkey AS conv_id FROM orders GROUP BY 1 HAVING count(*) = count(*) FILTER (o_orderstatus <> 'P')")
def contained_members(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("conv_id", F.col("o_custkey"))
    stories = o.groupBy("conv_id").agg(F.collect_list("o_orderkey").alias("members"))
    scenes = o.filter("o_orderstatus <> 'P'").select("conv_id", F.col("o_orderkey").alias("scene_id"))
    return serving.contained_members(stories, scenes).select("conv_id")


@query("o45_generation_choice", """WITH g AS (SELECT o_orderpriority AS k, max(o_orderdate) AS a FROM orders GROUP BY 1),
c AS (SELECT o.*, first_value(k) OVER (PARTITION BY o_custkey ORDER BY k <> '1-URGENT', a DESC, k) AS chosen, k FROM orders o JOIN g ON k = o_orderpriority)
SELECT o_custkey, o_orderkey, chosen FROM c WHERE k = chosen""")
def generation_choice(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("generation", F.col("o_orderpriority"))
    g = o.groupBy("generation").agg(F.max("o_orderdate").alias("activated_at"))
    return serving.chosen_generation(o.join(g, "generation"), "1-URGENT", ["o_custkey"]).select("o_custkey", "o_orderkey", "chosen")


@query("o63_owner_overlay", """WITH l AS (SELECT doc_id, quality, toxic FROM labels)
SELECT d.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'checked' ELSE d.lang END AS value FROM documents d LEFT JOIN l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 1""")
def owner_overlay(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("value"))
    kind = F.when(F.col("quality") == 0, "retract").when(F.col("toxic") == 0, "correct").otherwise("restore")
    owner = table(spark, sf, "labels").select(F.col("doc_id").alias("target"), F.col("doc_id").alias("id"), kind.alias("kind"), F.lit("checked").alias("value"), F.lit(0).alias("created_at"))
    return serving.overlaid(rows, owner, "doc_id").select("doc_id", "value")


@query("o72_prunable", "SELECT DISTINCT l_orderkey FROM lineitem a WHERE l_returnflag <> 'N' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'N')")
def prunable(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rev_id"), F.col("l_returnflag").alias("projection"))
    return serving.prunable(rows, "N", rows.limit(0).select("rev_id")).select(F.col("rev_id").alias("l_orderkey")).distinct()


@query("o117_active_generation", "SELECT o_orderstatus AS kind, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS key FROM orders GROUP BY 1")
def active_generation(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("key"), F.struct("o_orderdate", "o_orderkey").alias("activated_at"))
    return serving.active_generation(o)


@query("s01_job_order", """SELECT o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def job_order(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2030-01-01").cast("timestamp")
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("conv_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("claimed_at"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("not_before"))
    return serving.job_order(jobs, now).select("job_id", F.col("place").cast("bigint"))


@query("f06_backoff", "SELECT n, CAST(least(600, 15 * power(2, n)) AS INT) AS seconds FROM (SELECT DISTINCT CAST(p_size AS INT) AS n FROM part)")
def backoff(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct().withColumn("seconds", serving.backoff_seconds(F.col("n")))


# ---------------------------------------------------------------- aggregation


@query("o33_extraction_coverage", """SELECT o_custkey AS conv_id, count(*) AS eligible, count(*) FILTER (o_orderstatus = 'F') AS compiled, count(*) FILTER (o_orderstatus = 'O') AS pending,
    count(*) FILTER (o_orderstatus = 'P') AS not_queued, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS percent, count(*) = count(*) FILTER (o_orderstatus = 'F') AS complete FROM orders GROUP BY 1""")
def extraction_coverage(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderstatus")
    units = table(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"), (o == "F").alias("compiled"), F.when(o == "O", "queued").alias("job"), F.lit(False).alias("historical"), F.lit(False).alias("truncated"))
    return coverage.extraction_coverage(units).select("conv_id", "eligible", "compiled", "pending", "not_queued", "percent", "complete")


@query("o34_embedding_coverage", "SELECT lang AS conv_id, count(*) AS eligible, count(vec_id) AS embedded, count(*) FILTER (vec_id IS NOT NULL AND 700 < n_chars) AS partial FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1")
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("lang").alias("conv_id"), F.col("doc_id").alias("rev_id"), F.col("n_chars").alias("clean_chars"))
    return coverage.embedding_coverage(d, table(spark, sf, "embeddings").select(F.col("vec_id").alias("rev_id"), F.lit(700).alias("text_end")))


@query("o36_usage_totals", """WITH r AS (SELECT event_type AS generation, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type <> 'error' AS told FROM events)
SELECT generation, count(*) AS rows, count(*) FILTER (NOT told) AS not_recorded, count(*) AS calls, sum(CASE WHEN told THEN k END) AS input, count(CASE WHEN told THEN k END) AS input_reported FROM r GROUP BY ROLLUP (generation)""")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    told = F.when(F.col("event_type") != "error", k)
    none = F.lit(None).cast("bigint")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("generation"), F.lit(1).alias("calls"), told.alias("input"), none.alias("output"), none.alias("cached"), none.alias("reasoning"))
    return coverage.usage_totals(rows).select("generation", "rows", "not_recorded", "calls", "input", "input_reported")


@query("o39_source_counts", """SELECT l_returnflag AS predicate, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O", count(*) AS total FROM lineitem GROUP BY 1""")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.source_counts(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("predicate"), F.col("l_linestatus").alias("source")), ["F", "O"])


@query("o40_event_depth", """SELECT event_type AS generation, count(*) AS events, count(*) FILTER (value > 100) AS with_because, count(*) FILTER (value > 50) AS major FROM events GROUP BY ROLLUP (event_type)""")
def event_depth(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("generation"), F.array("user_id").alias("participants"), F.when(v > 100, "cause").alias("because"), F.lit(None).cast("string").alias("outcome"), F.when(v > 50, "major").alias("salience"))
    return coverage.event_depth(rows).select("generation", "events", "with_because", "major")


@query("o41_repeat_share", """WITH r AS (SELECT user_id AS conv_id, date_trunc('day', ts) AS n, list_sort(list_distinct(list(event_type))) AS lines FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(lines) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM r)
SELECT conv_id, round(avg(len(list_intersect(lines, before)) / len(lines)), 6) AS repeat_share, count(*) AS pairs FROM p WHERE before IS NOT NULL GROUP BY 1""")
def repeat_share(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").groupBy(F.col("user_id").alias("conv_id"), F.date_trunc("day", "ts").alias("n")).agg(F.array_sort(F.collect_set("event_type")).alias("lines"))
    return coverage.repeat_share(r).withColumn("repeat_share", F.round("repeat_share", 6))


@query("o42_policy_compare", """SELECT l_returnflag AS policy, count(DISTINCT l_orderkey) AS packets, sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) AS tokens,
    count(*) FILTER (l_linestatus = 'F' AND l_linenumber = 1) AS facts, count(*) FILTER (l_linenumber = 2) AS excerpt_offered FROM lineitem GROUP BY 1""")
def policy_compare(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") == 1, "fact").when(F.col("l_linenumber") == 2, "excerpt").otherwise("thread")
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("policy"), F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("tok"), (F.col("l_linestatus") == "F").alias("placed"), kind.alias("kind"))
    return coverage.policy_compare(rows).select("policy", "packets", F.col("tokens").cast("bigint").alias("tokens"), "facts", "excerpt_offered")


@query("o43_job_counts", "SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def job_counts(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.job_counts(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status")))


@query("o43_unserved_jobs", "SELECT o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def unserved_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return serving.unserved(jobs, ["1-URGENT", "2-HIGH"])


@query("o44_mode_summary", "SELECT lang AS mode, count(*) FILTER (quality = 1) AS gold, count(*) AS cases, count(*) FILTER (toxic = 1) AS stale, round(avg(n_chars), 4) AS mean_tokens FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def mode_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("mode"), (F.col("quality") == 1).alias("gold_reached"), (F.col("toxic") == 1).alias("stale"), F.lit(False).alias("irrelevant"), F.col("n_chars").alias("tokens"))
    return coverage.mode_summary(rows).select("mode", "gold", "cases", "stale", F.round("mean_tokens", 4).alias("mean_tokens"))


@query("o44b_distinct", "SELECT DISTINCT lang, source FROM documents")
def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("o90_tired_lines", """WITH o AS (SELECT user_id AS conv_id, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS request, event_type AS line, value > 200 AS echoed FROM events),
l AS (SELECT conv_id, max(request) AS last FROM o GROUP BY 1)
SELECT conv_id, line FROM o JOIN l USING (conv_id) WHERE request > last - 2 GROUP BY 1, 2 HAVING count(DISTINCT request) = 2 AND NOT bool_or(echoed)""")
def tired_lines(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.date_trunc("day", "ts"))
    o = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.dense_rank().over(w).alias("request"), F.col("event_type").alias("line"), F.lit(True).alias("placed"), (F.col("value") > 200).alias("echoed"))
    return coverage.tired_lines(o, 2)


# ---------------------------------------------------------------- state


@query("o47_current_state", "SELECT user_id, event_type AS key, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), F.get_json_object("props", "$.k").cast("bigint").alias("value"), F.col("ts").alias("position"), F.col("event_id").alias("rule_id"))
    return state.current_state(rows, ["user_id"]).select("user_id", "key", "value")


@query("o49_state_islands", """WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM f)
SELECT user_id, count(*) AS islands FROM f WHERE o = 1 GROUP BY 1""")
def state_islands(spark: SparkSession, sf: str) -> DataFrame:
    runs = state.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", "event_id")
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("islands"))


@query("o50_last_windows", """WITH w AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC) AS r FROM events)
SELECT user_id, count(*) AS rows, sum(k) AS k FROM w WHERE r <= 3 GROUP BY 1""")
def last_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").alias("position"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return state.last_windows(rows, ["user_id"], "position", 3).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("k"))


@query("o51_change_text", """WITH s AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, lag(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, CASE WHEN b IS NULL OR b = k THEN NULL WHEN k > b THEN '+' || (k - b) ELSE '−' || (b - k) END AS change FROM s""")
def change_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", state.change_text(F.lag(k).over(w), k).alias("change"))


@query("o70_status_flags")
def status_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("position"), F.get_json_object("props", "$.k").alias("value"), F.lit("").alias("prose"))
    return state.status_flags(rows, ["user_id"])


# ---------------------------------------------------------------- text and retrieval

GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substring('  ' || {0} || ' ', i, 3)))"
NORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'))"


@query("f01_grams", f"SELECT item_id, len({GRAMS.format(NORM.format('text'))}) AS grams FROM benchmark")
def gram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.size(fx.grams(F.col("text"))).cast("bigint").alias("grams"))


@query("o84_similarity", f"""WITH g AS (SELECT item_id, {GRAMS.format(NORM.format('text'))} AS g FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)), 6) AS similarity FROM g a JOIN g b ON b.item_id = a.item_id + 1""")
def similarity(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "benchmark").select("item_id", fx.grams(F.col("text")).alias("g"))
    b = g.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return g.join(b, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(fx.overlap(F.col("g"), F.col("h")), 6).alias("similarity"))


@query("o95_token_estimate", r"""WITH w AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS wide FROM documents)
SELECT doc_id, CAST(ceil((n - wide) / 3.5::DOUBLE + wide * 1.2::DOUBLE) AS BIGINT) AS tokens FROM w""")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.estimated_tokens(F.col("text")).alias("tokens"))


#: Of the markup that the pages have: what goes with its content, declarations, elements that end a line, other tags, entities.  HTML
#: reads these four entities without their semicolon too, as where a cut page ends; no other name but copysr begins with one of them.
CLEANED = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<![^>]*>', '', 'g'), '(?i)</?(br|p|div|li|tr|h[1-6]|details|summary|table|section)(\s[^<>]*)?/?>', chr(10), 'g'), '</?[a-zA-Z][^<>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, '&copysr;', '℗'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM b)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(regexp_replace(l, '[ \t\x{A0}]+', ' ', 'g'), ' ')), lambda l: l <> ''), chr(10)) AS text FROM c"""


@query("o12_clean_pages", CLEANED)
def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", fx.clean_text("html").alias("text"))


@query("o78_chunks")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(fx.chunked("text")).alias("chunk", "span")).select("doc_id", "chunk", "span.start", "span.end")


def _requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The latest user message of every conversation as a request with the reply before it, against the messages before it."""
    m = messages(spark, sf)
    last = m.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "position").alias("query"), F.max("position").alias("upto"))
    replies = m.filter("role = 'assistant'").join(last.select("conv_id", "upto"), "conv_id").filter("position < upto").groupBy("conv_id").agg(F.max_by("text", "position").alias("reply"))
    requests = last.join(replies, "conv_id", "left").select(F.col("conv_id").alias("request_id"), "conv_id", "query", "upto", "reply")
    return requests, m.join(last.select("conv_id", "upto"), "conv_id").filter("position < upto").select("conv_id", "rev_id", "position", "text")


REQUESTS = r"""WITH last AS (SELECT conv_id, arg_max(text, turn) AS query, max(turn) AS upto FROM conversations WHERE role = 'user' GROUP BY 1),
q AS (SELECT conv_id, list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM last),
qg AS (SELECT conv_id, list_distinct(flatten(list_transform(words, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM q),
t AS (SELECT c.conv_id, c.turn, list_filter(regexp_split_to_array(lower(c.text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM conversations c JOIN last l USING (conv_id) WHERE c.turn < l.upto),
tg AS (SELECT conv_id, turn, list_distinct(flatten(list_transform(words, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM t),
s AS (SELECT conv_id, turn, len(list_intersect(qg.g, tg.g)) / len(qg.g) AS score FROM qg JOIN tg USING (conv_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM s WHERE score >= 0.4)
"""


@query("o73_lexical", REQUESTS + "SELECT conv_id AS request_id, conv_id || ':' || turn AS rev_id, round(score, 6) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS rank FROM k WHERE n <= 200")
def lexical(spark: SparkSession, sf: str) -> DataFrame:
    requests, corpus = _requests(spark, sf)
    return retrieval.lexical_index(requests, corpus).select("request_id", "rev_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query("o52_broad_abstains", REQUESTS + "SELECT conv_id AS request_id, count(*) AS hits FROM k WHERE n <= 3 GROUP BY 1")
def broad_abstains(spark: SparkSession, sf: str) -> DataFrame:
    requests, corpus = _requests(spark, sf)
    return retrieval.lexical_index(requests, corpus, broad=3).groupBy("request_id").agg(F.count(F.lit(1)).alias("hits"))


def _extents(name: str, pairs: str) -> str:
    """SQL tables ending in one named so, (k, sim): the word similarity of rows (k, want, seq), extent by extent."""
    return f"""{name}_s AS (SELECT k, len(want) AS n, list_contains(want, g) AS hit, g, pos FROM (SELECT k, want, unnest(seq) AS g, unnest(range(1, len(seq) + 1)) AS pos FROM {pairs})),
{name}_m AS (SELECT k, n, hit, pos, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY k ORDER BY pos), false) AS begins, coalesce(lag(pos) OVER (PARTITION BY k, g ORDER BY pos), 0) AS prev FROM {name}_s),
{name}_e AS (SELECT e.k, e.n, sum(CASE WHEN e.prev < b.pos AND e.hit THEN 1 ELSE 0 END) OVER w AS s, sum(CASE WHEN e.prev < b.pos AND NOT e.hit THEN 1 ELSE 0 END) OVER w AS o
    FROM {name}_m b JOIN {name}_m e ON e.k = b.k WHERE b.begins AND e.pos >= b.pos WINDOW w AS (PARTITION BY e.k, b.pos ORDER BY e.pos)),
{name} AS (SELECT k, max(s / (n + o)) AS sim FROM {name}_e GROUP BY k)"""


_IN_ORDER = "flatten(list_transform({}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

SIMILAR = REQUESTS + f""", xs AS (SELECT conv_id, turn, {_IN_ORDER.format("words")} AS seq FROM t), up AS (SELECT conv_id, upto FROM last),
replies AS (SELECT c.conv_id, arg_max(c.text, c.turn) AS reply FROM conversations c JOIN up USING (conv_id) WHERE c.role = 'assistant' AND c.turn < upto GROUP BY 1),
p AS (SELECT {{'c': conv_id, 't': turn}} AS k, qg.g AS want, xs.seq FROM k JOIN qg USING (conv_id) JOIN xs USING (conv_id, turn)), {_extents("u", "p")},
h AS (SELECT k, sim, count(*) OVER (PARTITION BY k.c) AS n FROM u WHERE sim >= 0.4), good AS (SELECT k, sim FROM h WHERE n <= 200),
rp AS (SELECT k, list_distinct({_IN_ORDER.format(_WORDS.format("reply"))}) AS want, seq FROM good JOIN xs ON xs.conv_id = k.c AND xs.turn = k.t JOIN replies ON replies.conv_id = k.c), {_extents("v", "rp")},
f AS (SELECT good.k, good.sim AS user_score, good.sim + 0.2::DOUBLE * coalesce(v.sim, 0) AS score FROM good LEFT JOIN v ON v.k = good.k)
SELECT k.c AS request_id, k.c || ':' || k.t AS rev_id, round(user_score, 6) AS user_score, round(score, 6) AS score, row_number() OVER (PARTITION BY k.c ORDER BY score DESC, k.t DESC) AS rank FROM f"""


@query("o73_word_similarity", SIMILAR)
def word_similarity(spark: SparkSession, sf: str) -> DataFrame:
    requests, corpus = _requests(spark, sf)
    return retrieval.lexical(requests, corpus).select("request_id", "rev_id", F.round("user_score", 6).alias("user_score"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


#: Latin words only, for no message of the tables has Korean letters.
KEYWORDS = REQUESTS + f""", w AS (SELECT conv_id, list_filter(regexp_extract_all(lower(query), '[0-9a-z가-힣]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains(['the', 'and', 'what', 'who', 'where', 'when', 'why', 'how', 'was', 'were', 'did', 'does', 'is', 'are', 'you', 'that', 'this', 'with', 'about', 'now'], x)) AS k FROM last),
d AS (SELECT conv_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS k FROM w),
y AS (SELECT conv_id, unnest(list_transform(list_sort(list_transform(k, lambda x, i: lpad(CAST(999 - length(x) AS VARCHAR), 3, '0') || lpad(CAST(i AS VARCHAR), 9, '0') || x))[1:4], lambda x: substring(x, 13))) AS word FROM d),
xs AS (SELECT conv_id, turn, {_IN_ORDER.format("words")} AS seq FROM t), yg AS (SELECT conv_id, word, list_distinct({_IN_ORDER.format("[word]")}) AS want FROM y),
p AS (SELECT {{'c': conv_id, 'w': word, 't': turn}} AS k, want, seq FROM yg JOIN xs USING (conv_id) WHERE len(list_intersect(want, seq)) >= 0.8 * len(want)), {_extents("u", "p")},
found AS (SELECT k.c AS conv_id, k.w AS word, k.t AS turn FROM u WHERE sim >= 0.8), size AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
df AS (SELECT conv_id, word, count(*) AS df FROM found GROUP BY ALL), wt AS (SELECT conv_id, word, ln(n / df) AS weight FROM df JOIN size USING (conv_id) WHERE df <= 200 AND df * 2 <= n),
sc AS (SELECT conv_id, turn, round(sum(weight), 4) AS s FROM found JOIN wt USING (conv_id, word) GROUP BY ALL)
SELECT conv_id AS request_id, conv_id || ':' || turn AS rev_id, s AS keyword_score, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn DESC) AS rank FROM sc WHERE s > 0"""


@query("o75_keyword_route", KEYWORDS)
def keyword_route(spark: SparkSession, sf: str) -> DataFrame:
    requests, corpus = _requests(spark, sf)
    return retrieval.keyword_route(requests, corpus).select("request_id", "rev_id", "keyword_score", F.col("rank").cast("bigint").alias("rank"))


@query("o77_vector_search", """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(sim, 4) AS sim FROM r WHERE rank <= 10""")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")  # a stated query set, against all rows
    return retrieval.nearest(v, queries, 10, "vec_id").select("query_id", "vec_id", F.round("sim", 4).alias("sim"))


@query("o79_rank_fusion", REQUESTS + """, l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS rank FROM k WHERE n <= 200),
late AS (SELECT t.conv_id, t.turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM t),
u AS (SELECT conv_id, turn, rank, true AS strong FROM l UNION ALL SELECT conv_id, turn, rank, false FROM late)
SELECT conv_id AS request_id, conv_id || ':' || turn AS rev_id, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM u GROUP BY conv_id, turn HAVING bool_or(strong)""")
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    requests, corpus = _requests(spark, sf)
    late = requests.select("request_id", "conv_id").join(corpus, "conv_id").withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("position"))))
    fused = retrieval.fuse({"lexical": retrieval.lexical_index(requests, corpus).withColumn("strong", F.lit(True)), "late": late.withColumn("strong", F.lit(False))})
    return fused.select("request_id", "rev_id", F.round("rrf", 8).alias("rrf"))


@query("o80_quote_lines")
def quote_lines(spark: SparkSession, sf: str) -> DataFrame:
    requests, corpus = _requests(spark, sf)
    return retrieval.quote_lines(requests, corpus).select("request_id", "rev_id", "quote", "score", "rank")


@query("o87_excerpts")
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    requests, corpus = _requests(spark, sf)
    rows = retrieval.lexical(requests, corpus).join(corpus, ["rev_id", "position"]).join(requests.select("request_id", "query"), "request_id")
    return rows.select("request_id", "rev_id", retrieval.excerpt("text", "query", fx.keywords("query")).alias("excerpt"))


def _memory(corpus: DataFrame) -> recall_.Memory:
    """What the messages themselves say: the first sentence of each as an event, and a question of each as an open thread."""
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda x: F.length(x) >= 4)
    said = corpus.select("conv_id", "position", F.xxhash64("rev_id").alias("id"), F.element_at(F.split("text", r"(?<=[.!?])\s"), 1).alias("text"), F.get(words, F.lit(0)).alias("name")).filter("name is not null")
    facts = said.select("conv_id", "id", F.lit("event").alias("predicate"), F.array("name").alias("names"), "text", "position", F.array().cast("array<string>").alias("missing"))
    threads = said.filter("position % 3 = 0").select("conv_id", "id", F.lit("goal").alias("kind"), F.lower("name").alias("by"), F.lit(None).cast("string").alias("to"), "text", F.col("position").alias("turn"), F.lit("open").alias("status"))
    return recall_.Memory(facts=facts, threads=threads)


def recall(spark: SparkSession, sf: str, budget: int = 400) -> DataFrame:
    """Hybrid recall of every conversation's latest message: routes, fusion, facts, threads, quotes, packed under a budget."""
    requests, corpus = _requests(spark, sf)
    return recall_.retrieve(requests, corpus, _memory(corpus), budget)


@query("o97_recall")
def recall_query(spark: SparkSession, sf: str) -> DataFrame:
    return recall(spark, sf)


@query("o97_recall_all_routes")
def recall_all_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Recall with every route and every part of a memory: vectors of messages and requests (each has one of the table's, by a
    hash of its id), values that later messages replaced, the story, scenes, state and cast."""
    requests, corpus = _requests(spark, sf)
    v = table(spark, sf, "embeddings")
    n = v.count()
    vector = v.select(F.col("vec_id").alias("_v"), "embedding")
    of = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(n))
    vectors = corpus.withColumn("_v", of(F.col("rev_id"))).join(vector, "_v").select("conv_id", "rev_id", "position", "embedding")
    requests = requests.withColumn("_v", of(F.concat_ws(":", "conv_id", "upto"))).join(vector, "_v").drop("_v")
    word = F.get(F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda x: F.length(x) >= 4), F.lit(0))
    history = corpus.filter("position = 1").select("conv_id", F.substring("text", 1, 60).alias("old_value"), F.lit("nothing of the kind").alias("new_value"), F.lit(3).alias("turn"))
    first = corpus.withColumn("name", word).filter("name IS NOT NULL")
    memory = _memory(corpus)
    memory.vectors, memory.history = vectors, history
    memory.story = corpus.filter("position = 0").select("conv_id", F.substring("text", 1, 200).alias("text"))
    memory.scenes = corpus.select("conv_id", F.col("position").alias("window"), F.substring("text", 1, 80).alias("text"))
    memory.state = first.groupBy("conv_id", F.lower("name").alias("key")).agg(F.max_by(F.length("text").cast("string"), "position").alias("value"), F.max("position").alias("position"))
    memory.cast = first.select("conv_id", F.xxhash64("rev_id").alias("id"), F.array("name").alias("names"), F.concat("name", F.lit(" was there")).alias("text"))
    return recall_.retrieve(requests, corpus, memory)


@query("o93_prefix_fit", """WITH c AS (SELECT conv_id, turn, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations)
SELECT conv_id, turn, CAST(used AS BIGINT) AS used, used <= 500 AS placed FROM c""")
def prefix_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (-F.col("turn")).alias("n"), F.ceil(F.length("text") / 4).alias("cost"), F.lit(500).alias("budget"))
    return packing.prefix_fit(rows, ["conv_id"], ["n"], "cost", "budget").select("conv_id", "turn", "used", "placed")


# ---------------------------------------------------------------- folds


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as statements about their customers: the status of an order is the customer's status from then on."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    none = F.lit(None).cast("string")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("conv_id"), F.row_number().over(w).alias("position"), F.row_number().over(w).alias("turn"),
        F.lit("customer").alias("subject"), F.lit("character").alias("subject_type"), F.lit("has_status").alias("predicate"), none.alias("object"), none.alias("object_type"),
        F.col("o_orderstatus").alias("value"), F.lit("positive").alias("polarity"), F.lit("actual").alias("modality"),
        F.when(F.col("o_orderpriority") == "5-LOW", "character_claim").otherwise("narration").alias("source"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("someone")).alias("asserted_by"),
        F.lit("public").alias("knowledge"), none.alias("outcome"))


STATEMENTS = "WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn FROM orders)\n"


@query("o55_fact_versions", STATEMENTS + """SELECT o_custkey AS conv_id, o_orderkey AS id, CAST(lead(turn) OVER w AS INT) AS closed_turn, CASE WHEN lead(turn) OVER w IS NULL THEN 'current' ELSE 'superseded' END AS outcome
    FROM s WHERE o_orderpriority <> '5-LOW' WINDOW w AS (PARTITION BY o_custkey ORDER BY turn)""")
def fact_versions(spark: SparkSession, sf: str) -> DataFrame:
    return folds.versions(_statements(spark, sf)).select("conv_id", "id", "closed_turn", "outcome")


@query("o55_single_slot", STATEMENTS + "SELECT o_custkey AS conv_id, o_orderkey AS id, row_number() OVER w AS version, lead(o_orderstatus) OVER w AS closed_by FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY turn)")
def single_slot(spark: SparkSession, sf: str) -> DataFrame:
    return folds.single_slot_versions(_statements(spark, sf), ["conv_id"], ["position"]).select("conv_id", "id", F.col("version").cast("bigint"), "closed_by")


@query("o58_claims", STATEMENTS + "SELECT o_custkey AS conv_id, arg_max(o_orderkey, turn) AS id FROM s WHERE o_orderpriority = '5-LOW' GROUP BY 1")
def claims(spark: SparkSession, sf: str) -> DataFrame:
    return folds.claims(_statements(spark, sf)).select("conv_id", "id")


@query("o59_alias_components", """WITH e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
x AS (SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT 's' || s_suppkey AS node, n_regionkey AS r FROM x UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, n_regionkey FROM nation)
SELECT node, min(node) OVER (PARTITION BY r) AS root FROM g""")
def alias_components(spark: SparkSession, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    up = s.select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))
    return entities.alias_components(up.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))))


@query("o65_view_diff", """WITH b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT o_custkey, CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'gone' ELSE 'changed' END AS kind, b.n AS before, a.n AS after FROM b FULL JOIN a USING (o_custkey) WHERE b.n IS DISTINCT FROM a.n""")
def view_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    n = lambda p: o.filter(p).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return folds.view_diff(n("o_orderstatus = 'F'"), n("o_orderstatus <> 'O'"), ["o_custkey"], "n")


@query("o30_closest", """WITH p AS (SELECT l_orderkey, l_linenumber, l_discount AS score, row_number() OVER w AS n, lead(l_discount) OVER w AS nx FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_discount DESC))
SELECT l_orderkey, l_linenumber FROM p WHERE n = 1 AND score >= 0.05 AND (nx IS NULL OR score - nx >= 0.015)""")
def closest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("score"))
    return folds.closest(rows, ["l_orderkey"], "score", 0.05, 0.015).select("l_orderkey", "l_linenumber")


@query("o62_canon_conflicts", """WITH h AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, CASE WHEN row_number() OVER w = 1 THEN -1 ELSE row_number() OVER w END AS turn, lead(o_orderstatus) OVER w AS nx, lead(o_orderkey) OVER w AS nk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey AS conv_id, o_orderstatus AS canon_value, nx AS story_value FROM h WHERE turn < 0 AND nx IS NOT NULL AND nx <> o_orderstatus""")
def canon_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    s = _statements(spark, sf).withColumn("turn", F.when(F.col("position") == 1, -1).otherwise(F.col("position"))).withColumn("key", F.lit("status"))
    return folds.canon_conflicts(s).select("conv_id", "canon_value", "story_value")


# ---------------------------------------------------------------- views


@query("o100_fact_spans", STATEMENTS + """, i AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus THEN 1 ELSE 0 END AS o FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY turn)),
g AS (SELECT o_custkey, o_orderstatus AS value, turn AS start FROM i WHERE o = 1)
SELECT o_custkey AS conv_id, value, CAST(start AS INT) AS start, CAST(lead(start) OVER (PARTITION BY o_custkey ORDER BY start) - 1 AS INT) AS "end" FROM g""")
def fact_spans(spark: SparkSession, sf: str) -> DataFrame:
    return views.spans(_statements(spark, sf), ["conv_id"])


def _ties(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as ties between parts and suppliers, by the region of the supplier."""
    l, s, n = table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = l.join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return j.select(F.col("n_regionkey").alias("conv_id"), F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.concat(F.lit("q"), F.col("l_quantity").cast("int")).alias("object"),
        F.when(F.col("l_linestatus") == "F", -1).otherwise(1).alias("turn"), F.col("l_returnflag").alias("value"))


TIES = """WITH t AS (SELECT n_regionkey AS conv_id, 's' || l_suppkey AS s, 'q' || CAST(l_quantity AS INT) AS q, l_linestatus FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT conv_id, least(s, q) AS a, greatest(s, q) AS b, count(*) AS n, CASE WHEN bool_and(l_linestatus = 'F') THEN 'setting' WHEN bool_or(l_linestatus = 'F') THEN 'changed' ELSE 'story' END AS mark FROM t GROUP BY 1, 2, 3)
"""


@query("o102_map_edges", TIES + "SELECT * FROM e")
def map_edges(spark: SparkSession, sf: str) -> DataFrame:
    return views.edges(_ties(spark, sf))


@query("o102_map_nodes", TIES + """, d AS (SELECT conv_id, node, count(*) AS degree, sum(n) AS ties FROM (SELECT conv_id, a AS node, n FROM e UNION ALL SELECT conv_id, b, n FROM e) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY degree DESC, ties DESC, node) AS k FROM d)
SELECT conv_id, node, degree, CAST(ties AS BIGINT) AS ties FROM r WHERE k <= 40""")
def map_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return views.nodes(views.edges(_ties(spark, sf)))


@query("o103_pairs", TIES + "SELECT conv_id, least(s, q) AS a, greatest(s, q) AS b, count(*) AS lines FROM t GROUP BY 1, 2, 3")
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.pairs(_ties(spark, sf).withColumn("predicate", F.lit("feels_toward")))
    return rows.select("conv_id", "a", "b", F.size("lines").cast("bigint").alias("lines"))


@query("o105_stale_threads", """WITH l AS (SELECT user_id, max(event_id) AS now FROM events GROUP BY 1), t AS (SELECT user_id, event_type AS kind, max(event_id) AS last_turn FROM events GROUP BY 1, 2)
SELECT user_id AS conv_id, kind, now - last_turn AS unsaid FROM t JOIN l USING (user_id) WHERE kind IN ('click', 'purchase') AND now - last_turn > CASE kind WHEN 'click' THEN 1000 ELSE 2000 END""")
def stale_threads(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("turn"))
    open_ = e.groupBy("conv_id", "kind").agg(F.max("turn").alias("last_turn")).withColumn("status", F.lit("open"))
    return folds.stale_threads(open_, e.groupBy("conv_id").agg(F.max("turn").alias("turn")), {"click": 1000, "purchase": 2000, "view": None}).select("conv_id", "kind", "unsaid")


@query("o107_replaced_settings", STATEMENTS + """SELECT o_custkey AS conv_id, arg_min(o_orderstatus, turn) AS was, arg_max(o_orderstatus, turn) AS now FROM s GROUP BY 1 HAVING count(*) > 1 AND arg_min(o_orderstatus, turn) <> arg_max(o_orderstatus, turn)""")
def replaced_settings(spark: SparkSession, sf: str) -> DataFrame:
    s = _statements(spark, sf).withColumn("turn", F.when(F.col("position") == 1, -1).otherwise(F.col("position"))).withColumn("key", F.lit("status"))
    return views.replaced_settings(s).select("conv_id", "was", "now")


@query("o111_entity_hints", """WITH m AS (SELECT user_id AS conv_id, event_type AS name, max(event_id) AS last FROM events WHERE event_type <> 'error' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last DESC, name) AS k FROM m)
SELECT conv_id, name, last FROM r WHERE k <= 2""")
def entity_hints(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("name"), F.lit(0).alias("turn"), F.col("event_id").alias("position"), (F.col("event_type") == "error").alias("persona"))
    return views.entity_hints(m, 1, 2)


@query("o114_context_window", HEAD + ", k AS (SELECT conv_id, max(turn) AS t FROM turns GROUP BY 1) SELECT conv_id, position, turn, t AS target_turn FROM turns JOIN k USING (conv_id) WHERE turn BETWEEN t - 1 AND t")
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    h = ledger.with_turns(messages(spark, sf)).filter("turn is not null").select("conv_id", "position", F.col("turn").cast("int").alias("turn"))
    return views.context_window(h, h.groupBy("conv_id").agg(F.max("turn").alias("turn")))


@query("o128_query_texts", """WITH u AS (SELECT conv_id, max(turn) AS p, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT u.conv_id, u.query, (SELECT arg_max(c.text, c.turn) FROM conversations c WHERE c.conv_id = u.conv_id AND c.role <> 'user' AND c.turn < u.p) AS reply FROM u""")
def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    return views.query_texts(messages(spark, sf))


@query("x01_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, CAST(sum(o) AS BIGINT) AS sessions FROM g GROUP BY 1""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS"))
    return e.withColumn("o", gap.cast("int")).groupBy("user_id").agg(F.sum("o").alias("sessions"))


@query("o110_canon_in_force", "SELECT lang AS conv_id, doc_id AS key FROM documents WHERE lang = 'en' OR doc_id IN (SELECT doc_id FROM labels)")
def canon_in_force(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    entries = d.select(F.col("lang").alias("conv_id"), F.col("doc_id").alias("key"), F.when(F.col("lang") == "en", "card").otherwise("lore").alias("kind"), F.col("source").alias("hash"))
    seen = d.select(F.col("lang").alias("conv_id"), F.col("doc_id").alias("key")).join(table(spark, sf, "labels").select(F.col("doc_id").alias("key")), "key")
    return memory.canon_in_force(entries, seen).select("conv_id", "key")


@query("o120_stale_summaries", """SELECT o_custkey AS conv_id, o_orderkey AS "window" FROM orders s WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = s.o_custkey AND x.o_orderstatus = 'F' AND x.o_orderkey <= s.o_orderkey AND x.o_orderdate > s.o_orderdate)""")
def stale_summaries(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("window"), F.col("o_orderkey").alias("last_turn"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    return memory.stale_summaries(o, o.filter("o_orderstatus = 'F'").select("conv_id", F.col("window").alias("turn"), "created_at"))


@query("o109_unchecked_reveals", """SELECT e.user_id AS conv_id, e.event_id AS turn FROM events e WHERE e.ts < (SELECT max(x.ts + INTERVAL 1 DAY) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id < e.event_id)""")
def unchecked_reveals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("extracted_at"), F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    return memory.unchecked_reveals(e, e.filter("event_type = 'error'").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY")), e.limit(0))


@query("o124_canon_as_of", "SELECT user_id AS conv_id, arg_max(event_id, (ts, event_id)) AS entries FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def canon_as_of(spark: SparkSession, sf: str) -> DataFrame:
    applied = table(spark, sf, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("entries")).select(F.col("user_id").alias("conv_id"), "entries", F.col("ts").alias("applied_at"))
    return ledger.canon_as_of(applied, F.lit("2024-01-15").cast("timestamp_ntz"))


@query("o85_scene_cast", """WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1) SELECT DISTINCT user_id AS conv_id, event_type AS name FROM events JOIN l USING (user_id) WHERE event_id > last - 300""")
def scene_cast(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("name"), F.col("event_id").alias("turn"))
    return retrieval.cast_of(e, e, 300)


@query("o101_capped_timeline", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 3""")
def capped_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return views.capped(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")
