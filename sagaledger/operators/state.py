"""Status values over time: rules that read them, islands, windows, core keys, changes and flags."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LINE = re.compile(r"^\s*([^:：=\n]{1,40}?)\s*[:：=]\s*(.+?)\s*$")


def parse_rules(text: str | None, rules: list[dict]) -> list[dict]:
    """(rule_id, key, value) that rules read from a text; of a key that one rule reads twice the last value holds.

    A rule is {"id", "kind", ...}: regex (pattern with groups key and value, or a fixed key), block (lines of key and value
    between an opening and a closing mark), kv (such lines anywhere); "entity" puts a name before every key.
    """
    out: dict[tuple[str, str], str] = {}
    for rule in rules:
        prefix = f"{rule['entity']}." if rule.get("entity") else ""
        body = text or ""
        if rule["kind"] == "regex":
            for m in re.finditer(rule["pattern"], body):
                groups = m.groupdict()
                key = rule.get("key") or groups.get("key")
                if key and groups.get("value") is not None:
                    out[rule["id"], prefix + key.strip()] = groups["value"].strip()
            continue
        parts = [body]
        if rule["kind"] == "block":
            parts = re.findall(re.escape(rule["open"]) + r"(.*?)" + re.escape(rule["close"]), body, re.DOTALL)
        for part in parts:
            for line in part.splitlines():
                if m := _LINE.match(line):
                    out[rule["id"], prefix + m[1]] = m[2]
    return [{"rule_id": r, "key": k, "value": v} for (r, k), v in out.items()]


def observations(messages: DataFrame, rules: list[dict]) -> DataFrame:
    """(every column of messages but text), rule_id, key, value."""

    @F.pandas_udf("array<struct<rule_id:string,key:string,value:string>>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_rules(t, rules))

    rest = [c for c in messages.columns if c != "text"]
    return messages.select(*rest, F.explode(read("text")).alias("o")).select(*rest, "o.*")


def rules_version(rules: list[dict]) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(rules, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def islands(rows: DataFrame, by: list[str], order: list[str], value: str, first: str) -> DataFrame:
    """Runs of one value in order: by, island, value, first and last of a column, and how many rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    opens = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    numbered = rows.withColumn("island", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.first(value).alias(value), F.min(first).alias(f"first_{first}"), F.max(first).alias(f"last_{first}"), F.count(F.lit(1)).alias("rows"))


def last_windows(rows: DataFrame, by: list[str], position: str, n: int) -> DataFrame:
    """The rows at the last n distinct positions of each key."""
    return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(position)))).filter(F.col("_r") <= n).drop("_r")


def as_maps(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """(by, position, values): each window's keys and values as one map; of a repeated key the last rule's holds."""
    last = rows.groupBy(*by, position, "key").agg(F.max_by("value", "rule_id").alias("value"))
    return last.groupBy(*by, position).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("values"))


def current_state(rows: DataFrame, by: list[str]) -> DataFrame:
    """The latest value of every key."""
    return rows.groupBy(*by, "key").agg(F.max_by("value", F.struct("position", "rule_id")).alias("value"), F.max("position").alias("position"))


SCENE_KEYS = ("date", "날짜", "time", "시간", "시각", "location", "place", "장소", "위치")


def core_keys(rows: DataFrame, by: list[str], position: str, windows: int = 10) -> DataFrame:
    """Keys that changed in at least half of the last windows of their conversation, and keys of date, time and place."""
    recent = last_windows(rows, by, position, windows)
    count = recent.groupBy(*by).agg(F.count_distinct(position).alias("n"))
    w = Window.partitionBy(*by, "key").orderBy(position)
    dense = recent.withColumn("_w", F.dense_rank().over(Window.partitionBy(*by).orderBy(position)))
    changed = (F.lag("value").over(w) != F.col("value")) & (F.lag("_w").over(w) == F.col("_w") - 1)
    per = dense.withColumn("_c", F.coalesce(changed, F.lit(False))).groupBy(*by, "key").agg(F.count_if("_c").alias("changes"))
    scene = F.lower(F.element_at(F.split("key", r"\."), -1)).isin(*SCENE_KEYS)
    return per.join(count, by).filter(scene | (F.col("changes") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))).select(*by, "key", "changes")


def signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).when(n < 0, F.concat(F.lit("−"), (-n).cast("string"))).otherwise(F.lit("+0"))


def change_text(before: Column, after: Column) -> Column:
    """How a value differs from the one before it: a signed number, a fraction's parts, or a list's items; else null."""
    whole = r"^\s*([+-]?\d{1,3}(?:,\d{3})+|[+-]?\d+)\s*$"
    part = r"^\s*([+-]?[\d,]+)\s*/\s*([+-]?[\d,]+)\s*$"
    num = lambda c, p, g: F.regexp_replace(F.regexp_extract(c, p, g), ",", "").try_cast("bigint")
    items = lambda c: F.transform(F.split(c, r" / |, "), lambda x: F.trim(x))
    listed = lambda c: F.size(items(c)) >= 3
    top, most = signed(num(after, part, 1) - num(before, part, 1)), num(after, part, 2) - num(before, part, 2)
    more = F.transform(F.array_except(items(after), items(before)), lambda x: F.concat(F.lit("+"), x))
    less = F.transform(F.array_except(items(before), items(after)), lambda x: F.concat(F.lit("−"), x))
    told = F.array_join(F.concat(more, less), " · ")
    return (
        F.when(before.isNull() | (before == after), F.lit(None).cast("string"))
        .when(before.rlike(whole) & after.rlike(whole), signed(num(after, whole, 1) - num(before, whole, 1)))
        .when(before.rlike(part) & after.rlike(part), F.when(most == 0, top).otherwise(F.concat(top, F.lit(", max "), signed(most))))
        .when((listed(before) | listed(after)) & (told != ""), told))


def status_flags(rows: DataFrame, by: list[str], prose: str = "prose") -> DataFrame:
    """Changes of watched values that the message's own words do not mention: added, dropped, number or reverted.

    rows: by, key, position, value, prose.
    """
    w = Window.partitionBy(*by, "key").orderBy("position")
    r = rows.withColumn("before", F.lag("value").over(w)).withColumn("earlier", F.lag("value", 2).over(w)).filter(F.col("before").isNotNull() & (F.col("before") != F.col("value")))
    number = r"^\s*[+-]?[\d,]+\s*(?:/\s*[\d,]+)?\s*$"
    kind = F.when(F.col("earlier") == F.col("value"), "reverted").when(F.col("before").rlike(number) & F.col("value").rlike(number), "number").when(F.length("value") < F.length("before"), "dropped").otherwise("added")
    return r.filter(~F.contains(F.lower(prose), F.lower("value"))).select(*by, "key", "position", "before", "value", kind.alias("flag"))


def bracket_candidates(messages: DataFrame) -> DataFrame:
    """(conv_id, keys, n, example): bracketed blocks of key and value lines with one key set, seen twice or more."""

    @F.pandas_udf("array<struct<keys:string,block:string>>")
    def blocks(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[dict]:
            found = []
            for body in re.findall(r"\[([^\[\]]{3,600})\]", text or ""):
                keys = sorted({m[1] for line in re.split(r"[\n|]", body) if (m := _LINE.match(line))})
                if len(keys) >= 2:
                    found.append({"keys": "|".join(keys), "block": body})
            return found

        return texts.map(of)

    rows = messages.select("conv_id", "position", F.explode(blocks("text")).alias("b"))
    return rows.groupBy("conv_id", F.col("b.keys").alias("keys")).agg(F.count(F.lit(1)).alias("n"), F.max_by("b.block", "position").alias("example")).filter("n >= 2")


def source_clock(rows: DataFrame) -> DataFrame:
    """(rev_id, category, value): the one literal date or time of a recalled message; several of a kind say nothing."""
    kind = F.when(F.lower("key").isin("date", "날짜"), "date").when(F.lower("key").isin("time", "시간", "시각"), "time")
    return rows.withColumn("category", kind).filter("category is not null").groupBy("rev_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).filter("n = 1").drop("n")


def asked_keys(query: Column, key: Column) -> Column:
    """Whether a message names a status key as a word of its own."""
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.lower(key), F.lit(" ")))
