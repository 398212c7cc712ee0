"""More registered queries: folds with denials, the memory view, judging and packing, views and hints, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import entities, folds, ledger, memory, packing, retrieval, serving, state, views
from ..sources.tables import messages, table
from .catalog import GRAMS, NORM, STATEMENTS, query

_STATEMENT_COLUMNS = ("id", "conv_id", "position", "turn", "subject", "subject_type", "predicate", "object", "object_type", "value", "polarity", "modality", "source", "asserted_by", "knowledge", "outcome")


def _statements(rows: DataFrame, **columns) -> DataFrame:
    """Assertions with the given columns, and plain narration for all others."""
    plain = {
        "subject": F.lit("one"), "subject_type": F.lit("character"), "predicate": F.lit("has_status"), "polarity": F.lit("positive"), "modality": F.lit("actual"),
        "source": F.lit("narration"), "knowledge": F.lit("public"),
    } | columns
    return rows.select(*[plain.get(c, F.lit(None).cast("string")).alias(c) for c in _STATEMENT_COLUMNS])


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their place among their customer's."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").withColumn("turn", F.row_number().over(w))


def _ordered(spark: SparkSession, sf: str, **columns) -> DataFrame:
    return _statements(_orders(spark, sf), id=F.col("o_orderkey"), conv_id=F.col("o_custkey"), position=F.col("turn"), turn=F.col("turn"), **columns)


def _spans(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 3, 1) + 1), lambda i: substring({x}, i, 4)))"


def _squash(x: str) -> str:
    return rf"regexp_replace(lower(coalesce({x}, '')), '\s+', '', 'g')"


def _reuse(a: str, b: str) -> str:
    """Share of a's four-character spans that b has, both squashed."""
    return f"""CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 WHEN length({a}) <= 4 THEN CASE WHEN contains({b}, {a}) THEN 1.0 ELSE 0.0 END
        ELSE len(list_intersect({_spans(a)}, {_spans(b)})) / len({_spans(a)}) END"""


# ---------------------------------------------------------------- ledger


@query("o04_output_hint", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def output_hint(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").select("event_id", F.col("ts").alias("observed_at"), F.format_string("%012d", "event_id").alias("conv_id"), F.concat_ws(":", "user_id", "event_type").alias("idempotency_key"))
    return ledger.idempotent(seen).select("event_id")


@query("o13_manifest_hash", """SELECT conv_id, sha256('[' || string_agg('{"id":"' || conv_id || ':' || turn || '","hash":"' || sha256(text) || '"}', ',' ORDER BY turn) || ']') AS manifest_hash FROM conversations GROUP BY 1""")
def manifest_hash(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.manifest_hash(messages(spark, sf).select("conv_id", "position", F.col("rev_id").alias("object_id"), "rev_hash"))


@query("o02_bodies_against_a_store", """SELECT sha256(text) AS rev_hash FROM conversations WHERE sha256(text) NOT IN (SELECT sha256(text) FROM conversations WHERE role = 'assistant') GROUP BY 1""")
def bodies_against_a_store(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select(F.lit("o").alias("object_id"), "conv_id", "role", "rev_hash")
    known = m.filter("role = 'assistant'").select("object_id", "rev_hash").distinct()
    return ledger.missing_bodies(m, known).select("rev_hash").distinct()


@query("o125_note_blocks", "SELECT conv_id, turn, text, [CAST(turn AS INT), 7]::VARCHAR AS turns FROM conversations")
def note_blocks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    note = lambda n, text: F.concat(F.lit("[Notes turn "), n.cast("string"), F.lit("]\nkept\n"), text, F.lit("[/Notes]\n"))
    text, turns = ledger.strip_note_blocks(F.concat(note(F.col("turn"), F.lit("lines\n")), F.col("text"), note(F.lit(7), F.lit(""))))
    return c.select("conv_id", "turn", text.alias("text"), F.concat(F.lit("["), F.array_join(turns.cast("array<string>"), ", "), F.lit("]")).alias("turns"))


@query("o126_in_context", "SELECT conv_id AS request_id, conv_id || ':' || turn AS object_id FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn > last - 3")
def in_context(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).withColumn("text", F.concat("rev_id", F.lit(" "), "text", F.lit(" "), "rev_id", F.lit(" "), F.sha2("rev_id", 512), F.lit(" "), "text"))
    m = m.withColumn("last", F.max("position").over(Window.partitionBy("conv_id"))).withColumn("text", F.sha2("rev_id", 512))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    prompt = ordered(F.when(F.col("position") > F.col("last") - 3, F.struct("position", F.concat(F.lit("said: "), "text", F.lit("\n")).alias("v"))))
    chat = ordered(F.struct("position", F.struct(F.col("rev_id").alias("object_id"), "text").alias("v")))
    return ledger.in_context_rows(m.groupBy(F.col("conv_id").alias("request_id")).agg(prompt.alias("prompt"), chat.alias("chat")))


# ---------------------------------------------------------------- serving


@query("o72_prunable_but_pins", """SELECT DISTINCT l_orderkey FROM lineitem a WHERE l_returnflag <> 'N' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'N')
    AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def prunable_but_pins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rev_id"), F.col("l_returnflag").alias("projection"))
    pins = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("rev_id"))
    return serving.prunable(rows, "N", pins).select(F.col("rev_id").alias("l_orderkey")).distinct()


@query("o109_checked_reveals", """WITH s AS (SELECT e.*, (SELECT max(x.ts + INTERVAL 1 DAY) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id < e.event_id) AS newest FROM events e)
SELECT user_id AS conv_id, event_id AS turn FROM s WHERE newest IS NOT NULL AND greatest(ts, CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 2 DAY ELSE ts END) < newest""")
def checked_reveals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("extracted_at"), F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    later = lambda kind, days: e.filter(F.col("event_type") == kind).withColumn("created_at", F.col("created_at") + F.expr(f"INTERVAL {days} DAY"))
    return memory.unchecked_reveals(e, later("error", 1), later("purchase", 2))


@query("o37_work_counters", """SELECT 'facts' AS what, count(*) AS n FROM lineitem UNION ALL SELECT 'summaries', count(*) FROM customer
    UNION ALL SELECT 'summary jobs ' || o_orderstatus, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def work_counters(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "summary").otherwise("embed").alias("kind"), F.col("o_orderstatus").alias("status"))
    return memory.work_counters(table(spark, sf, "lineitem"), table(spark, sf, "customer"), jobs)


@query("o53_sorted_orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def sorted_orders(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("place"))


# ---------------------------------------------------------------- registry and evidence

#: Lines of orders with one of four words each.
LINES = "(SELECT *, ['AIR', 'MAIL', 'RAIL', 'SHIP'][CAST(l_partkey % 4 AS INT) + 1] AS word FROM lineitem)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("word", F.element_at(F.array(*map(F.lit, ("AIR", "MAIL", "RAIL", "SHIP"))), (F.col("l_partkey") % 4 + 1).cast("int")))


LISTED = f"""WITH a AS (SELECT l_orderkey, l_linenumber, ['has_status', 'possesses', 'located_in', 'goal', 'flies', 'destroyed', 'relationship'][l_linenumber] AS predicate,
    CASE WHEN l_returnflag = 'R' THEN ' ' ELSE 's' || l_suppkey END AS subject, CASE WHEN l_linestatus = 'F' THEN 'character' ELSE 'item' END AS subject_type,
    CASE WHEN l_quantity >= 25 THEN 'p' || l_partkey END AS object, CASE word WHEN 'AIR' THEN 'place' WHEN 'MAIL' THEN 'item' WHEN 'RAIL' THEN 'character' END AS object_type,
    CASE WHEN l_discount < 0.02 THEN ' ' ELSE word END AS value FROM {LINES})
"""


@query("o14_validity", LISTED + """SELECT l_orderkey, l_linenumber, CASE WHEN predicate = 'flies' THEN 'unknown predicate' WHEN trim(subject) = '' THEN 'no subject'
    WHEN NOT list_contains(CASE predicate WHEN 'possesses' THEN ['character', 'group'] WHEN 'located_in' THEN ['character', 'item', 'group'] WHEN 'goal' THEN ['character', 'group'] WHEN 'destroyed' THEN ['item'] ELSE ['character'] END, subject_type) THEN 'subject type'
    WHEN predicate IN ('possesses', 'located_in', 'relationship') AND object IS NULL THEN 'no object'
    WHEN (predicate = 'possesses' AND object_type <> 'item') OR (predicate = 'located_in' AND object_type <> 'place') OR (predicate = 'relationship' AND object_type <> 'character') THEN 'object type'
    WHEN predicate NOT IN ('located_in', 'possesses') AND trim(value) = '' THEN 'no value' END AS reason FROM a""")
def validity(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("has_status", "possesses", "located_in", "goal", "flies", "destroyed", "relationship")))
    mode = F.col("word")
    rows = _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", F.element_at(names, F.col("l_linenumber").cast("int")).alias("predicate"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.concat(F.lit("s"), "l_suppkey")).alias("subject"),
        F.when(F.col("l_linestatus") == "F", "character").otherwise("item").alias("subject_type"), F.when(F.col("l_quantity") >= 25, F.concat(F.lit("p"), "l_partkey")).alias("object"),
        F.when(mode == "AIR", "place").when(mode == "MAIL", "item").when(mode == "RAIL", "character").alias("object_type"), F.when(F.col("l_discount") < 0.02, " ").otherwise(mode).alias("value"))
    return folds.validity(rows).select("l_orderkey", "l_linenumber", "reason")


@query("o15_filled_types", """WITH m AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS type FROM orders)
SELECT o_orderkey, coalesce(type, CASE WHEN min(type) OVER w = max(type) OVER w THEN max(type) OVER w END) AS type FROM m WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)""")
def filled_types(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("conv_id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("type"))
    return folds.filled_types(m).select("o_orderkey", "type")


@query("o16_cleaned_fields", """WITH a AS (SELECT o_orderkey, lower(o_orderstatus) AS s, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CASE s WHEN 'f' THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN p = '1-URGENT' THEN 'dreamed' ELSE 'actual' END AS modality,
    CASE WHEN p = '2-HIGH' AND s = 'o' THEN 'character_claim' ELSE 'narration' END AS source, CASE WHEN p = '2-HIGH' AND s = 'o' THEN 'Someone' END AS asserted_by,
    CASE WHEN s = 'f' THEN 'achieved' END AS outcome, CASE WHEN s <> 'f' AND p = '3-MEDIUM' THEN 'major' END AS salience FROM a""")
def cleaned_fields(spark: SparkSession, sf: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    none = F.array().cast("array<string>")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(s == "F", " Negative ").otherwise("maybe").alias("polarity"), F.when(p == "1-URGENT", "DREAMED").alias("modality"), F.when(p == "2-HIGH", "character_claim").otherwise("rumour").alias("source"),
        F.when(s == "O", " Someone ").otherwise(" ").alias("asserted_by"), F.lit("public").alias("knowledge"), none.alias("known_by"), none.alias("hidden_from"),
        F.when(s == "F", "resolved").otherwise("event").alias("predicate"), F.lit("Achieved").alias("outcome"), F.when(p == "3-MEDIUM", "major").otherwise("huge").alias("salience"))
    return memory.cleaned_fields(rows).select("o_orderkey", "polarity", "modality", "source", "asserted_by", "outcome", "salience")


@query("o17_evidence", f"""WITH q AS (SELECT item_id, substring(text, 3, 10 + CAST(item_id % 9 AS INT)) AS piece, CASE WHEN item_id % 2 = 0 THEN text ELSE upper(reverse(text)) || substring(text, 3, 12) END AS shown FROM benchmark),
g AS (SELECT item_id, trim(piece) AS p, shown, {GRAMS.format(NORM.format("trim(piece)"))} AS a, {GRAMS.format(NORM.format("shown"))} AS b FROM q)
SELECT item_id, p <> '' AND CASE WHEN length(p) >= 12 THEN len(list_intersect(a, b)) / len(a) >= 0.7 ELSE contains(lower(shown), lower(p)) END AS shown FROM g""")
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    other = F.concat(F.upper(F.reverse("text")), F.substring("text", 3, 12))
    q = b.select("item_id", F.substring("text", F.lit(3), 10 + (F.col("item_id") % 9).cast("int")).alias("piece"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(other).alias("shown"))
    return q.select("item_id", views.quoted_in(F.col("piece"), F.col("shown")).alias("shown"))


@query("o18_mentioned", r"""WITH n AS (SELECT conv_id, arg_min(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), turn) AS words FROM conversations GROUP BY 1),
w AS (SELECT conv_id, list_filter(words, lambda x: length(x) >= 2)[1] AS name FROM n)
SELECT c.conv_id, c.turn, contains(' ' || regexp_replace(lower(c.text), '[^\p{Latin}\p{N}]+', ' ', 'g') || ' ', ' ' || lower(name) || ' ') AS mentioned FROM conversations c JOIN w USING (conv_id) WHERE name IS NOT NULL""")
def mentioned(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    words = F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " ")
    names = c.groupBy("conv_id").agg(F.min_by(F.get(F.filter(words, lambda x: F.length(x) >= 2), F.lit(0)), "turn").alias("name")).filter("name is not null")
    return c.join(names, "conv_id").select("conv_id", "turn", views.mentioned(F.col("name"), F.col("text")).alias("mentioned"))


@query("o19_conditional_blocks", """WITH t AS (SELECT item_id, substring(text, 1, 60) AS a, substring(text, 61, 60) AS b, substring(text, 9, 2) AS e FROM benchmark),
n AS (SELECT item_id, (length(a) - length(replace(a, e, ''))) / length(e) AS inside, (length(b) - length(replace(b, e, ''))) / length(e) AS outside FROM t)
SELECT item_id, outside > 0 AND outside >= inside AS shown FROM n""")
def conditional_blocks(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("{{#if mood}}"), F.substring("text", 1, 60), F.lit("{{/if}}"), F.substring("text", 61, 60))
    return table(spark, sf, "benchmark").select("item_id", views.shown_unconditionally(text, F.substring("text", 9, 2)).alias("shown"))


@query("o20_scene_privacy", """WITH c AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS cast_ FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN coalesce(array_to_string(list_filter(cast_, lambda x: x <> o_orderpriority), ','), '') ELSE '' END AS missing FROM orders LEFT JOIN c USING (o_custkey)""")
def scene_privacy(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "conv_id")
    facts = o.select("conv_id", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "limited").otherwise("public").alias("knowledge"), F.array("o_orderpriority").alias("known_by"))
    cast = o.filter("o_orderstatus = 'O'").select("conv_id", F.col("o_orderpriority").alias("name"))
    return folds.private_in_scene(facts, cast).select("o_orderkey", F.array_join("missing", ",").alias("missing"))


@query("o31_restated", """WITH a AS (SELECT *, 'status ' || o_orderstatus AS v FROM orders), n AS (SELECT DISTINCT o_custkey, v FROM a WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey AS id FROM a WHERE o_orderpriority <> '1-URGENT' AND NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = a.o_custkey)""")
def restated(spark: SparkSession, sf: str) -> DataFrame:
    s = _ordered(spark, sf, value=F.concat(F.lit("status "), "o_orderstatus"), modality=F.col("o_orderpriority")).withColumn("turn", F.lit(1))
    return memory.restated(s.filter("modality <> '1-URGENT'"), s.filter("modality = '1-URGENT'")).select("id")


@query("o32_joined_turns", """SELECT o_custkey AS conv_id, year(o_orderdate) AS turn FROM orders GROUP BY 1, 2 HAVING count(*) FILTER (o_orderpriority = '1-URGENT') > 0 AND count(*) FILTER (o_orderpriority = '2-HIGH') > 0""")
def joined_turns(spark: SparkSession, sf: str) -> DataFrame:
    shown = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("conv_id"), F.year("o_orderdate").cast("bigint").alias("turn")).agg(F.array(F.array(F.lit("nobody")), F.collect_set("o_orderpriority")).alias("entities"))
    return entities.joined_turns(shown, "1-URGENT", "2-HIGH")


# ---------------------------------------------------------------- folds

DENIED = STATEMENTS.replace("AS turn FROM orders)", "AS turn, o_orderpriority <> '4-NOT SPECIFIED' AS pos, o_orderstatus AS v FROM orders)")


@query("o55_fact_denials", DENIED + """, t AS (SELECT *, last_value(CASE WHEN pos THEN v END IGNORE NULLS) OVER b AS held, first_value(v) OVER b AS opening FROM s WINDOW b AS (PARTITION BY o_custkey ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, pos OR opening IS NULL OR coalesce(held, opening) = v AS takes FROM t),
n AS (SELECT *, lead(turn) OVER x AS taker, lead(pos) OVER x AS taker_pos, lead(turn) OVER y AS again, lead(takes) OVER y AS again_takes FROM k WINDOW x AS (PARTITION BY o_custkey, takes ORDER BY turn), y AS (PARTITION BY o_custkey, v ORDER BY turn))
SELECT o_orderkey AS id, CASE WHEN takes THEN CASE WHEN taker IS NULL THEN 'current' WHEN taker_pos THEN 'superseded' ELSE 'ended' END ELSE CASE WHEN again IS NULL THEN 'current' ELSE 'superseded' END END AS outcome,
    CAST(CASE WHEN takes THEN taker WHEN again_takes THEN again END AS INT) AS closed_turn FROM n""")
def fact_denials(spark: SparkSession, sf: str) -> DataFrame:
    polarity = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "negative").otherwise("positive")
    return folds.versions(_ordered(spark, sf, value=F.col("o_orderstatus"), polarity=polarity)).select("id", "outcome", "closed_turn")


@query("o56_whereabouts", """WITH s AS (SELECT l_suppkey, l_partkey, l_suppkey * 1000000 + row_number() OVER w AS id, row_number() OVER w AS turn FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice))
SELECT id, CASE WHEN lead(turn) OVER v IS NULL THEN 'current' ELSE 'superseded' END AS outcome, CAST(lead(turn) OVER v AS INT) AS closed_turn, false AS disputed FROM s WINDOW v AS (PARTITION BY l_suppkey, l_partkey ORDER BY turn)""")
def whereabouts(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    l = _lines(spark, sf).withColumn("turn", F.row_number().over(w))
    held, item, who = F.col("l_linestatus") == "O", F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("o"), "l_orderkey")
    rows = _statements(l, id=F.col("l_suppkey") * 1000000 + F.col("turn"), conv_id=F.col("l_suppkey"), position=F.col("turn"), turn=F.col("turn"), predicate=F.when(held, "possesses").otherwise("located_in"),
        subject=F.when(held, who).otherwise(item), subject_type=F.when(held, "character").otherwise("item"), object=F.when(held, item).otherwise(F.col("word")))
    return folds.versions(rows).select("id", "outcome", "closed_turn", "disputed")


@query("o56_destroyed_items", STATEMENTS + """, k AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'gone' ELSE 'held' END AS what, lead(turn) OVER w AS nt, lead(o_orderstatus) OVER w AS ns FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY turn))
SELECT o_orderkey AS id, CASE WHEN nt IS NULL THEN 'current' WHEN what = 'held' AND ns = 'F' THEN 'ended' WHEN what = 'gone' AND ns <> 'F' THEN 'conflicting' ELSE 'superseded' END AS outcome, CAST(nt AS INT) AS closed_turn FROM k""")
def destroyed_items(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.col("o_orderstatus") == "F"
    rows = _ordered(spark, sf, predicate=F.when(gone, "destroyed").otherwise("possesses"), subject=F.when(gone, "map").otherwise(F.col("o_orderpriority")), object=F.when(~gone, "map"), value=F.when(gone, "burnt"))
    return folds.versions(rows).select("id", "outcome", "closed_turn")


@query("o57_pair_fold", STATEMENTS + """, k AS (SELECT *, o_orderstatus = 'F' AS side, o_orderpriority < '3' AS sym FROM s),
n AS (SELECT *, lead(turn) OVER (PARTITION BY o_custkey ORDER BY turn) AS anyone, lead(turn) OVER (PARTITION BY o_custkey, side ORDER BY turn) AS same,
    min(CASE WHEN sym THEN turn END) OVER (PARTITION BY o_custkey ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS mutual FROM k),
e AS (SELECT o_orderkey, CASE WHEN sym THEN anyone ELSE least(coalesce(same, mutual), coalesce(mutual, same)) END AS t FROM n)
SELECT o_orderkey AS id, CASE WHEN t IS NULL THEN 'current' ELSE 'superseded' END AS outcome, CAST(t AS INT) AS closed_turn FROM e""")
def pair_fold(spark: SparkSession, sf: str) -> DataFrame:
    left = F.col("o_orderstatus") == "F"
    rows = _ordered(spark, sf, predicate=F.lit("relationship"), subject=F.when(left, "Ann").otherwise("Bo"), object=F.when(left, "Bo").otherwise("Ann"), value=F.when(F.col("o_orderpriority") < "3", "friends").otherwise("mentor"))
    return folds.versions(rows).select("id", "outcome", "closed_turn")


@query("o54_secret_fold", f"""SELECT a.l_orderkey * 10 + a.l_linenumber AS id, lower(a.l_returnflag) AS name, CAST(min(b.l_linenumber) AS INT) AS learned_turn
FROM {LINES} a LEFT JOIN {LINES} b ON b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.word = a.word AND b.l_linestatus = 'F' AND b.l_linenumber >= a.l_linenumber
WHERE a.l_linestatus = 'O' OR a.l_quantity > 25 GROUP BY 1, 2""")
def secret_fold(spark: SparkSession, sf: str) -> DataFrame:
    l = _lines(spark, sf).select(F.col("l_orderkey").alias("conv_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").cast("int").alias("turn"), "l_linestatus", "l_quantity",
        F.col("word").alias("value"), F.col("l_returnflag").alias("who"), F.lit("actual").alias("modality"))
    told = l.filter("l_linestatus = 'F'").select("conv_id", "id", "turn", "value", F.col("who").alias("subject"), "modality", F.lit("learned").alias("predicate"), F.lit("public").alias("knowledge"), F.array().cast("array<string>").alias("hidden_from"))
    kept = l.filter("l_linestatus = 'O' or l_quantity > 25").select("conv_id", "id", "turn", "value", F.lit("x").alias("subject"), "modality", F.lit("identity").alias("predicate"), F.lit("limited").alias("knowledge"), F.array("who").alias("hidden_from"))
    return folds.secrets_open(kept.unionByName(told)).select("id", "name", "learned_turn")


@query("o60_threads", STATEMENTS + """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'kept' WHEN o_orderstatus = 'P' THEN 'broken' ELSE 'open' END AS status, CAST(CASE WHEN o_orderstatus <> 'O' THEN 2 * turn + 1 END AS INT) AS closed_turn FROM s""")
def threads(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("bring parcel "), F.format_string("%012d", F.col("o_orderkey")))
    o = _orders(spark, sf)
    made = _statements(o, id=F.col("o_orderkey"), conv_id=F.col("o_custkey"), position=2 * F.col("turn"), turn=2 * F.col("turn"), predicate=F.lit("promised"), object=F.lit("two"), value=text)
    end = F.when(F.col("o_orderstatus") == "F", "fulfilled").otherwise("promised")
    ended = _statements(o.filter("o_orderstatus <> 'O'"), id=-F.col("o_orderkey"), conv_id=F.col("o_custkey"), position=2 * F.col("turn") + 1, turn=2 * F.col("turn") + 1, predicate=end, object=F.lit("two"), value=text,
        polarity=F.when(F.col("o_orderstatus") == "P", "negative").otherwise("positive"))
    return folds.threads(made.unionByName(ended)).select("id", "status", "closed_turn")


@query("o61_cause_links", STATEMENTS + """SELECT b.o_orderkey AS id, max(a.o_orderkey) AS event_id FROM s b JOIN s a ON a.o_custkey = b.o_custkey AND a.turn = b.turn - 1 WHERE a.o_orderkey <> b.o_orderkey GROUP BY 1""")
def cause_links(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("turn")
    # The texts are digests, so a cause is like the event it names and unlike the others of its scene.
    o = _orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("conv_id"), F.col("turn").alias("position"), "turn", F.lit("one").alias("subject"), F.lit(None).cast("string").alias("object"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("value"), F.concat(F.lit("since "), F.sha2(F.lag("o_orderkey").over(w).cast("string"), 256)).alias("because"))
    return folds.cause_links(o, o).select("id", "event_id")


@query("o64_memory_view", STATEMENTS + "SELECT o_custkey AS conv_id, arg_max(o_orderkey, turn) AS id FROM s WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def memory_view(spark: SparkSession, sf: str) -> DataFrame:
    low = F.col("o_orderpriority") == "5-LOW"
    s = _ordered(spark, sf, value=F.col("o_orderstatus"), source=F.when(low, "character_claim").otherwise("narration"), asserted_by=F.when(low, "someone")).withColumn("hidden_from", F.array().cast("array<string>"))
    none = spark.createDataFrame([], "conv_id bigint, id bigint, kind string, type string, name string, other string, created_at timestamp")
    return memory.memory_view(s, none)["facts"].select("conv_id", "id")


@query("o104_events", "SELECT o_orderkey AS id, CAST(turn AS INT) AS turn FROM (" + STATEMENTS + "SELECT * FROM s) WHERE o_orderstatus = 'F'")
def events_list(spark: SparkSession, sf: str) -> DataFrame:
    s = _ordered(spark, sf, predicate=F.when(F.col("o_orderstatus") == "F", "event").otherwise("goal"), value=F.lit("x"))
    return views.events_list(s.withColumn("participants", F.array("subject")).withColumn("salience", F.lit("minor")).withColumn("because", F.lit(None).cast("string"))).select("id", F.col("turn").cast("int").alias("turn"))


@query("o106_role_endings", STATEMENTS + """, m AS (SELECT o_custkey, max(turn) AS now FROM s GROUP BY 1) SELECT o_custkey AS conv_id, o_orderpriority AS value, turn FROM s JOIN m USING (o_custkey) WHERE o_orderstatus = 'F' AND turn > now - 5""")
def role_endings(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    history = o.select(F.col("o_custkey").alias("conv_id"), F.lit("k").alias("key"), F.col("o_orderpriority").alias("value"), F.lit("role_toward").alias("predicate"), F.when(F.col("o_orderstatus") == "F", "ended").otherwise("current").alias("standing"), F.col("turn").alias("closed_turn"))
    last = o.groupBy(F.col("o_custkey").alias("conv_id")).agg(F.max("turn").alias("turn"))
    return memory.role_endings(history, last, 5).select("conv_id", "value", F.col("turn").cast("bigint").alias("turn"))


# ---------------------------------------------------------------- text


@query("o74_keywords", r"""WITH u AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[0-9a-z가-힣]+') AS w FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, list_filter(w, lambda x: regexp_full_match(x, '[a-z]{3,}') AND NOT list_contains(['the', 'and', 'what', 'who', 'where', 'when', 'why', 'how', 'was', 'were', 'did', 'does', 'is', 'are', 'you', 'that', 'this', 'with', 'about', 'now'], x)) AS k FROM u),
d AS (SELECT conv_id, turn, list_filter(k, lambda x, i: list_position(k, x) = i) AS k FROM s)
SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(k, lambda x, i: lpad(CAST(999 - length(x) AS VARCHAR), 3, '0') || lpad(CAST(i AS VARCHAR), 9, '0') || x))[1:4], lambda x: substring(x, 13)), ',') AS keywords FROM d""")
def keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.array_join(fx.keywords("text"), ",").alias("keywords"))


@query("f10_asked_keys", r"""SELECT conv_id, turn, k.key, contains(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' ' || k.key || ' ') AS asked FROM conversations, (VALUES ('the'), ('an'), ('hp')) k(key)""")
def asked_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("key", F.explode(F.array(*map(F.lit, ("the", "an", "hp")))))
    return c.select("conv_id", "turn", "key", state.asked_keys(F.col("text"), F.col("key")).alias("asked"))


@query("o70_explained_changes", """WITH e AS (SELECT user_id, event_type AS key, event_id AS position, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS value, CASE WHEN event_id % 2 = 0 THEN 'it is ' || CAST(json_extract(props, '$.k') AS BIGINT) ELSE 'nothing said' END AS prose FROM events),
l AS (SELECT *, lag(value) OVER w AS before, lag(value, 2) OVER w AS earlier FROM e WINDOW w AS (PARTITION BY user_id, key ORDER BY position))
SELECT user_id, key, position, before, value, CASE WHEN earlier = value THEN 'reverted' ELSE 'number' END AS flag FROM l WHERE before IS NOT NULL AND before <> value AND NOT contains(lower(prose), value)""")
def explained_changes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    prose = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("it is "), k)).otherwise("nothing said")
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("position"), k.alias("value"), prose.alias("prose"))
    return state.status_flags(rows, ["user_id"])


@query("o51_core_keys", """WITH d AS (SELECT user_id, date_trunc('day', ts) AS position, event_type AS key, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS value FROM events GROUP BY 1, 2, 3),
w AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY position DESC) AS back FROM d), r AS (SELECT * FROM w WHERE back <= 10),
c AS (SELECT user_id, count(DISTINCT position) AS n FROM r GROUP BY 1),
l AS (SELECT *, lag(value) OVER x <> value AND lag(back) OVER x = back + 1 AS changed FROM r WINDOW x AS (PARTITION BY user_id, key ORDER BY position))
SELECT user_id, key, count(*) FILTER (changed) AS changes FROM l JOIN c USING (user_id) GROUP BY user_id, key, n HAVING count(*) FILTER (changed) >= greatest(1, floor(n / 2))""")
def core_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("position"), F.col("event_type").alias("key")).agg(F.max_by(F.get_json_object("props", "$.k"), F.struct("ts", "event_id")).alias("value"))
    return state.core_keys(rows, ["user_id"], "position")


@query("o92_source_clock", """SELECT event_id % 500 AS rev_id, CASE event_type WHEN 'click' THEN 'date' ELSE 'time' END AS category, min(CAST(user_id AS VARCHAR)) AS value FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2 HAVING count(*) = 1""")
def source_clock(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Date").when(F.col("event_type") == "purchase", "시간").otherwise("mood")
    return state.source_clock(table(spark, sf, "events").select((F.col("event_id") % 500).alias("rev_id"), kind.alias("key"), F.col("user_id").cast("string").alias("value")))


# ---------------------------------------------------------------- judging and packing


@query("o83_not_replaced", f"""WITH m AS (SELECT conv_id, turn, text, lag(text) OVER w AS old, lead(text) OVER w AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT conv_id, {_squash("substring(old, 1, 40)")} AS o, {_squash("substring(new, 1, 40)")} AS n, turn AS since FROM m WHERE old IS NOT NULL AND new IS NOT NULL),
x AS (SELECT conv_id, turn, {_squash("text")} AS t FROM conversations)
SELECT conv_id, turn FROM x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = x.conv_id AND x.turn < h.since AND {_reuse("h.o", "x.t")} >= 0.5 AND {_reuse("h.n", "x.t")} < 0.5)""")
def not_replaced(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    history = c.select("conv_id", "turn", F.substring(F.lag("text").over(w), 1, 40).alias("old_value"), F.substring(F.lead("text").over(w), 1, 40).alias("new_value")).filter("old_value is not null and new_value is not null")
    return retrieval.not_replaced(c.select("conv_id", "turn", "text"), history).select("conv_id", "turn")


@query("o98_audit", f"""WITH l AS (SELECT conv_id, turn AS upto, {_squash("text")} AS a FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, upto, a, (SELECT {_squash("arg_min(c.text, c.turn)")} FROM conversations c WHERE c.conv_id = l.conv_id AND c.role = 'assistant' AND c.turn > l.upto) AS b FROM l)
SELECT conv_id || ':' || upto AS trace_id, {_reuse("a", "b")} >= 0.3 AS echoed, {_reuse("a", "b")} >= 0.3 AND upto % 2 = 0 AS possible_leak FROM r WHERE b <> ''""")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    lines = m.filter("role = 'user'").select(F.col("rev_id").alias("trace_id"), "conv_id", F.col("position").alias("upto"), F.lit("r").alias("ref"), "text", F.lit(True).alias("placed"), (F.col("position") % 2 == 0).alias("hidden"))
    return packing.audit(lines, m.filter("role = 'assistant'"), 0.3).select("trace_id", "echoed", "possible_leak")


@query("o88_summary_gate", f"""WITH s AS (SELECT item_id % 20 AS conv_id, item_id AS ref, {GRAMS.format(NORM.format("text"))} AS g FROM benchmark),
k AS (SELECT (item_id + 1) % 20 AS conv_id, {GRAMS.format(NORM.format("substring(text, 1, 30)"))} AS g, item_id % 40 < 20 AS here FROM benchmark WHERE item_id % 3 = 0)
SELECT conv_id, ref FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = s.conv_id AND len(list_intersect(k.g, s.g)) / len(k.g) >= CASE WHEN here THEN 0.3 ELSE 0.7 END)""")
def summary_gate(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumn("conv_id", F.col("item_id") % 20)
    told = b.filter("item_id % 3 = 0").withColumn("conv_id", (F.col("item_id") + 1) % 20)
    secrets = told.select("conv_id", F.col("item_id").cast("string").alias("name"), F.substring("text", 1, 30).alias("secret"))
    absent = told.filter("item_id % 40 < 20").select("conv_id", F.col("item_id").cast("string").alias("name"))
    return memory.summary_gate(b.select("conv_id", F.col("item_id").alias("ref"), "text"), secrets, absent).select("conv_id", "ref")


@query("o121_chronicle", f"""WITH s AS (SELECT conv_id, turn, text, {_squash("text")} AS t FROM conversations), k AS (SELECT conv_id, {_squash("substring(text, 1, 25)")} AS s FROM conversations WHERE turn = 1),
c AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = s.conv_id AND {_reuse("k.s", "s.t")} >= 0.7)),
r AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM c)
SELECT conv_id, turn FROM r WHERE used <= 1500""")
def chronicle(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ref"), "turn", "text")
    return memory.chronicle(c, c.filter("turn = 1").select("conv_id", F.substring("text", 1, 25).alias("secret")), 1500).select("conv_id", "turn")


@query("o82_thread_relevance", f"""WITH t AS (SELECT o_custkey // 30 AS c, o_orderkey AS id, o_orderpriority AS text, lower(o_orderstatus) || lower(o_orderstatus) AS who, o_orderkey AS turn FROM orders WHERE o_orderstatus <> 'P'),
q AS (SELECT c_custkey AS request_id, c_custkey // 30 AS c, CASE WHEN c_custkey % 3 = 0 THEN '1-URGENT now' ELSE 'is oo here' END AS query, 'ff said' AS reply FROM customer),
m AS (SELECT request_id, id, turn, CASE WHEN len(list_intersect({GRAMS.format(NORM.format("text"))}, {GRAMS.format(NORM.format("query"))})) / len({GRAMS.format(NORM.format("text"))}) >= 0.2 THEN 3
    WHEN contains(query, who) THEN 2 WHEN contains(reply, who) THEN 1 ELSE 0 END AS mention FROM q JOIN t USING (c)),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY mention DESC, turn DESC, id DESC) AS rank FROM m WHERE mention > 0)
SELECT request_id, id, mention, rank FROM r WHERE rank <= 6""")
def thread_relevance(spark: SparkSession, sf: str) -> DataFrame:
    who = F.repeat(F.lower("o_orderstatus"), 2)
    open_ = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.floor(F.col("o_custkey") / 30).alias("conv_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), who.alias("by"), F.lit(None).cast("string").alias("to"), F.col("o_orderkey").alias("turn"), F.lit("open").alias("status"))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.floor(F.col("c_custkey") / 30).alias("conv_id"), F.when(F.col("c_custkey") % 3 == 0, "1-URGENT now").otherwise("is oo here").alias("query"), F.lit("ff said").alias("reply"))
    return retrieval.relevant_threads(asked, open_).select("request_id", "id", "mention", F.col("rank").cast("bigint").alias("rank"))


@query("o81_fact_relevance", f"""WITH f AS (SELECT o_custkey // 30 AS c, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'event' ELSE 'has_status' END AS predicate, lower(o_orderstatus) || 'x' AS who, o_orderpriority AS text, o_orderkey AS position FROM orders),
q AS (SELECT c_custkey AS request_id, c_custkey // 30 AS c, CASE WHEN c_custkey % 2 = 0 THEN 'where is ox' ELSE '2-HIGH?' END AS query, 'the fx left' AS reply FROM customer),
m AS (SELECT request_id, id, predicate, position, CASE WHEN contains(query, who) THEN 2.0 WHEN contains(reply, who) THEN 1.5 ELSE 0 END AS m,
    len(list_intersect({GRAMS.format(NORM.format("query"))}, {GRAMS.format(NORM.format("text"))})) / len({GRAMS.format(NORM.format("query"))}) + CASE predicate WHEN 'event' THEN 0.2 ELSE 0.3 END AS more FROM q JOIN f USING (c)),
s AS (SELECT *, round(m + more, 4) AS score, row_number() OVER (PARTITION BY request_id, predicate = 'event' ORDER BY round(m + more, 4) DESC, position DESC, id) AS e FROM m WHERE m > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, position DESC, id) AS rank FROM s WHERE predicate <> 'event' OR e <= 4)
SELECT request_id, id, score, rank FROM r WHERE rank <= 12""")
def fact_relevance(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 30).alias("conv_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "event").otherwise("has_status").alias("predicate"),
        F.array(F.concat(F.lower("o_orderstatus"), F.lit("x"))).alias("names"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("position"))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.floor(F.col("c_custkey") / 30).alias("conv_id"), F.when(F.col("c_custkey") % 2 == 0, "where is ox").otherwise("2-HIGH?").alias("query"), F.lit("the fx left").alias("reply"))
    return retrieval.relevant_facts(asked, facts).select("request_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("o91_cast_groups", """SELECT id FROM (SELECT o_orderkey AS id, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderpriority <> '5-LOW')
WHERE n <= CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END""")
def cast_groups(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    facts = o.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("predicate"), F.col("o_orderdate").alias("position"), F.col("o_orderkey").alias("id"))
    cast = o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderpriority").alias("name")).distinct()
    return retrieval.cast_groups(facts, cast, {"F": 1, "O": 2}).select("id")


@query("o89_strict_mode", """WITH p AS (SELECT o_custkey, o_orderpriority AS who, min(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT o_custkey AS request_id, n, 'secret' AS kind, 'Something known to ' || who || ', not known to Bo.' AS text FROM p UNION ALL SELECT o_custkey, o_orderkey, 'fact', o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""")
def strict_mode(spark: SparkSession, sf: str) -> DataFrame:
    missing = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Bo"))).otherwise(F.array().cast("array<string>"))
    lines = table(spark, sf, "orders").select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("n"), F.array("o_orderpriority").alias("holders"), missing.alias("missing"), F.lit("fact").alias("kind"), F.col("o_orderpriority").alias("text"))
    return packing.strict_mode(lines).select("request_id", "n", "kind", "text")


@query("o93_packing", """WITH RECURSIVE l AS (SELECT o_custkey AS r, o_orderkey AS ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, ceil((length(o_orderpriority || ' ' || o_orderkey) + 1) / 3.5) AS tok FROM orders),
p AS (SELECT r, ref, n, tok, ceil(19 / 3.5) + tok <= 40 AS placed, ceil(19 / 3.5) + CASE WHEN ceil(19 / 3.5) + tok <= 40 THEN tok ELSE 0 END AS used FROM l WHERE n = 1
UNION ALL SELECT l.r, l.ref, l.n, l.tok, p.used + l.tok <= 40, p.used + CASE WHEN p.used + l.tok <= 40 THEN l.tok ELSE 0 END FROM p JOIN l ON l.r = p.r AND l.n = p.n + 1)
SELECT r AS request_id, ref, CAST(tok AS INT) AS tok, placed, CASE WHEN placed THEN 'placed' ELSE 'budget' END AS why FROM p""")
def packed_lines(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    lines = table(spark, sf, "orders").select(F.col("o_custkey").alias("request_id"), F.row_number().over(w).alias("n"), F.lit(40).alias("budget"), F.lit("fact").alias("kind"), F.col("o_orderkey").alias("ref"),
        F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("text"), F.lit(None).cast("string").alias("head"), F.lit(False).alias("private"))
    return packing.pack(lines).select("request_id", "ref", "tok", "placed", "why")


# ---------------------------------------------------------------- views and hints


@query("o108_divergence", """WITH t AS (SELECT o_custkey % 20 AS conv_id, o_orderpriority AS key, count(DISTINCT o_orderstatus) AS entities, sum(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS times FROM (SELECT DISTINCT o_custkey % 20 AS o_custkey, o_orderpriority, o_orderstatus FROM orders) GROUP BY 1, 2)
SELECT conv_id, key, entities, times, chars FROM (SELECT *, sum(100) OVER (PARTITION BY conv_id ORDER BY entities DESC, times DESC, key) AS chars FROM t) WHERE chars <= 300""")
def divergence(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("conv_id"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("name")).distinct()
    entries = o.groupBy("conv_id", "key").agg(F.collect_set("name").alias("names")).withColumn("text", F.repeat(F.lit("x"), 100))
    named = o.select("conv_id", "name").distinct().withColumn("n", F.when(F.col("name") == "F", 3).when(F.col("name") == "O", 2).otherwise(1)).withColumn("last_turn", F.lit(1))
    return views.divergence_candidates(entries, named, 300).select("conv_id", "key", "entities", "times", "chars")


@query("o112_open_items", """SELECT id FROM (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE n <= 2""")
def open_items(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    items = o.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("turn"), F.array("o_orderpriority").alias("names"))
    prompt = o.select(F.col("o_custkey").alias("conv_id")).distinct().withColumn("text", F.lit("See 1-Urgent and 2-HIGH."))
    return views.open_item_hints(items, prompt, 2).select("id")


@query("o113_name_pairs", """SELECT conv_id, long, short FROM (SELECT DISTINCT o_custkey AS conv_id, 'Kim ' || o_orderstatus || o_orderstatus AS long, o_orderstatus || o_orderstatus AS short FROM orders) WHERE short IN ('FF', 'OO')""")
def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"), F.concat(F.lit("Kim "), F.repeat("o_orderstatus", 2)).alias("name")).distinct()
    return views.name_pairs(names, names.select("conv_id").distinct().withColumn("text", F.lit("then ff met oo, not PPx"))).select("conv_id", "long", "short")


@query("o115_listed_endings", """SELECT o_orderkey AS turn, CASE WHEN o_orderstatus = 'P' THEN 'not listed' WHEN o_orderpriority > '3' THEN 'no evidence' WHEN o_orderstatus = 'O' THEN 'party not named' ELSE 'accepted' END AS why FROM orders""")
def listed_endings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"), F.lit("i").alias("item"), "o_orderstatus", "o_orderpriority")
    answers = o.select("conv_id", "turn", "item", F.lit("Hana put the lamp out at last").alias("evidence"))
    listed = o.filter("o_orderstatus <> 'P'").select("conv_id", "turn", "item", F.when(F.col("o_orderstatus") == "F", "hana").otherwise("Jun").alias("party"))
    turns = o.select("conv_id", "turn", F.when(F.col("o_orderpriority") > "3", "It rained all night long.").otherwise("So Hana put the lamp out at last, and slept.").alias("text"))
    return memory.accepted_endings(answers, listed, turns).select("turn", "why")


@query("o116_speakers", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS speaker FROM orders")
def speakers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"), F.lit(1).alias("turn"), F.col("o_orderkey").alias("ordinal"), F.lit("q").alias("quote"), "o_orderstatus", "o_orderpriority")
    entries = F.collect_list(F.when(F.col("o_orderstatus") == "F", F.struct("ordinal", "o_orderpriority")))
    answers = o.groupBy("conv_id", "turn").agg(F.map_from_entries(entries).alias("names"))
    return views.quote_speakers(o, answers).select(F.col("ordinal").alias("o_orderkey"), "speaker")


@query("o122_status_blocks", """SELECT conv_id, CASE role WHEN 'user' THEN 'hp|mp' ELSE 'day|hp' END AS keys, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) >= 2""")
def status_blocks(spark: SparkSession, sf: str) -> DataFrame:
    block = F.when(F.col("role") == "user", "a [hp: 3 | mp: 4] b").otherwise("[hp: 9\nday: Monday]")
    m = messages(spark, sf).select("conv_id", "position", block.alias("text"))
    return state.bracket_candidates(m).select("conv_id", "keys", "n")


@query("o123_hub", """WITH n AS (SELECT o_custkey, count(*) AS people, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS stale, count(*) FILTER (o_orderpriority = '5-LOW') AS changed FROM orders GROUP BY 1)
SELECT c_custkey AS conv_id, c_nationkey AS done, c_nationkey + 1 AS due, coalesce(people, 0) AS people, coalesce(open, 0) AS open, coalesce(stale, 0) AS stale, coalesce(changed, 0) AS changed FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def hub(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "conv_id").withColumn("status", F.when(F.col("o_orderstatus") == "O", "open").otherwise("kept"))
    due = table(spark, sf, "customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_nationkey").alias("compiled"), (F.col("c_nationkey") + 1).alias("eligible"))
    return views.hub(o, o, o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '5-LOW'"), due)


@query("o127_held_keys", """SELECT a.item_id % 10 AS conv_id, a.item_id AS key FROM benchmark a WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id % 10 = a.item_id % 10 AND b.item_id % 3 = 0 AND contains(b.text, substring(a.text, 1, 60)))""")
def held_keys(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumn("conv_id", F.col("item_id") % 10)
    texts = b.select("conv_id", F.col("item_id").alias("key"), F.substring("text", 1, 60).alias("text"))
    return views.held_keys(texts, b.filter("item_id % 3 = 0").select("conv_id", F.col("text").alias("prompt")))


@query("o128_injection", """WITH p AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS m FROM conversations GROUP BY 1),
k AS (SELECT conv_id, m, coalesce(list_max(list_filter(range(1, len(m) + 1), lambda i: m[i].role <> 'user')), 0) AS k FROM p)
SELECT conv_id, array_to_string(list_concat(list_transform(m[1:k], lambda x: x.text), ['packet'], list_transform(m[k + 1:], lambda x: x.text)), '|') AS prompt FROM k""")
def injection(spark: SparkSession, sf: str) -> DataFrame:
    prompts = messages(spark, sf).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("m"))
    return prompts.select("conv_id", F.array_join(F.transform(views.injected(F.col("m"), F.lit("packet")), lambda m: m["text"]), "|").alias("prompt"))


@query("o59_resolved_names", """WITH n AS (SELECT DISTINCT o_custkey AS conv_id, o_orderpriority AS name, o_orderstatus FROM orders),
a AS (SELECT conv_id, name FROM n GROUP BY 1, 2 HAVING count(*) FILTER (o_orderstatus = 'F') > 0),
m AS (SELECT conv_id, name, min(k) AS first FROM (SELECT o_custkey AS conv_id, o_orderpriority AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) GROUP BY 1, 2)
SELECT m.conv_id, count(*) AS names, count(DISTINCT CASE WHEN a.name IS NULL THEN m.name ELSE 'x' END) AS entities FROM m LEFT JOIN a ON a.conv_id = m.conv_id AND a.name = m.name GROUP BY 1""")
def resolved_names(spark: SparkSession, sf: str) -> DataFrame:
    # A finished order says that its priority is another name of the first such one: a star of names, which one entity has.
    first = F.min_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.when(F.col("o_orderstatus") == "F", F.col("turn"))).over(Window.partitionBy("o_custkey"))
    o = _orders(spark, sf).withColumn("first", first)
    alias = F.when((F.col("o_orderstatus") == "F") & (F.col("first") != F.col("o_orderpriority")), F.col("first"))
    rows = _statements(o, id=F.col("o_orderkey"), conv_id=F.col("o_custkey"), position=F.col("turn"), turn=F.col("turn"), subject=F.col("o_orderpriority"), predicate=F.when(alias.isNotNull(), "also_called").otherwise("has_status"), value=alias)
    # The owner links what would be ambiguous: the middle of a star with several arms.
    none = spark.createDataFrame([], "conv_id bigint, id bigint, kind string, type string, name string, other string, created_at timestamp")
    links = rows.filter("predicate = 'also_called'").select("conv_id", "id", F.lit("link").alias("kind"), F.lit("character").alias("type"), F.col("subject").alias("name"), F.col("value").alias("other"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    found = entities.resolve(rows, none.unionByName(links))
    return found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("names"), F.count_distinct("entity_id").alias("entities"))
