"""Budget packing: ordered lines into as many tokens as a request has, with a ledger that says why each was kept or not.

A line's cost may depend on the lines kept before it, so a request is a group (``pack``); where costs are the lines' own a
running sum says the same without Python (``prefix_fit``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._grouped import fold_groups

#: Tokens that a character outside ASCII counts as, by policy; features that policies switch on, cumulatively.
POLICIES = {f"v{i}": {"non_ascii": 1.5 if i < 2 else 1.2, "reserve": i >= 1, "private": i >= 3, "restate": i >= 4, "story": i >= 8, "labels": i >= 17} for i in range(20)}
DEFAULT_POLICY = "v19"
STATE_SHARE, STORY_SHARE, EXCERPT_SHARE = 0.4, 0.3, 0.3
FIT_STEP, FIT_CAP = 100, 8000
ORDER = ("state", "story", "cast", "lead", "thread", "fact", "claim", "secret", "quote", "excerpt")
MEMORY = ("state", "lead", "thread", "fact", "claim")
FRAME = "<memory>\n</memory>"
PRIVATE_NOTE = "Lines marked private are known to some of the scene only."


def tokens(text: str, non_ascii: float) -> int:
    plain = sum(ord(c) < 128 for c in text)
    return math.ceil(plain / 3.5 + (len(text) - plain) * non_ascii)


@dataclass
class Entry:
    at: int
    tok: int = 0
    placed: bool = False
    why: str = "budget"


def pack_lines(lines: list[dict], budget: int, policy: str = DEFAULT_POLICY) -> list[Entry]:
    """One entry per line, in the lines' order: its cost, whether it is placed, and why not.

    lines: kind, text, head, private.  Kinds are filled in a fixed order; state and story have caps; from policy v1 on room
    is held back for the best excerpt; from v4 on a line that says again what an earlier one says stays out.
    """
    p = POLICIES[policy]
    cost = lambda text: tokens(text + "\n", p["non_ascii"])
    out = [Entry(i) for i in range(len(lines))]
    used = cost(FRAME)
    if used >= budget:
        return out
    inner = budget - used
    order = sorted(range(len(lines)), key=lambda i: (ORDER.index(lines[i]["kind"]), i))
    said: set[tuple] = set()
    best = next((i for i in order if lines[i]["kind"] == "excerpt"), None)
    reserve = min(cost(lines[best]["text"]), int(inner * EXCERPT_SHARE)) if p["reserve"] and best is not None else 0
    caps = {"state": STATE_SHARE, "story": STORY_SHARE} if p["reserve"] else {}
    spent = dict.fromkeys(ORDER, 0)
    noted = False
    for i in order:
        kind, text = lines[i]["kind"], lines[i]["text"]
        e = out[i]
        if kind == "story" and not p["story"]:
            e.why = "policy"
            continue
        key = (lines[i].get("head"), text)
        if p["restate"] and key in said:
            e.why = "restated"
            continue
        said.add(key)
        e.tok = cost(text)
        if p["private"] and lines[i].get("private") and not noted:
            e.tok += cost(PRIVATE_NOTE)
        held = 0 if kind in ("excerpt", "quote") else reserve
        if kind in caps and spent[kind] + e.tok > int(inner * caps[kind]):
            e.why = f"{kind}_cap"
        elif used + e.tok > budget - held:
            e.why = "budget"
        else:
            e.placed, e.why = True, "placed"
            used += e.tok
            spent[kind] += e.tok
            noted = noted or bool(p["private"] and lines[i].get("private"))
    return out


def fits_at(lines: list[dict], budget: int, policy: str = DEFAULT_POLICY) -> int | None:
    """The smallest budget, in steps, above this one that cuts no memory line; None if the cap cuts some."""
    cut = lambda n: sum(lines[e.at]["kind"] in MEMORY and e.why == "budget" for e in pack_lines(lines, n * FIT_STEP, policy))
    low, high = budget // FIT_STEP + 1, FIT_CAP // FIT_STEP
    if low > high or cut(high):
        return None
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if cut(middle) else (low, middle)
    return high * FIT_STEP


def pack(lines: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """(request_id, n, kind, ref, tok, placed, why) for lines (request_id, n, budget, kind, ref, text, head, private)."""
    kind = dict(lines.dtypes)

    def fold(key: tuple, group: list[dict]) -> list[dict]:
        found = pack_lines(group, group[0]["budget"], policy)
        return [{"request_id": key[0], "n": r["n"], "kind": r["kind"], "ref": r["ref"], "tok": e.tok, "placed": e.placed, "why": e.why} for r, e in zip(group, found)]

    return fold_groups(lines, ["request_id"], ["n"], fold, f"request_id {kind['request_id']}, n int, kind string, ref {kind['ref']}, tok int, placed boolean, why string")


def prefix_fit(lines: DataFrame, by: list[str], order: list[str], cost: str, budget: str) -> DataFrame:
    """lines with used and placed: each line while the sum up to it fits."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(cost).over(w)).withColumn("placed", F.col("used") <= F.col(budget))


def strict_mode(lines: DataFrame) -> DataFrame:
    """Private lines without their content: one per set of holders and absent, and the other lines as they are."""
    private = lines.filter(F.size("missing") > 0)
    text = F.concat(F.lit("Something known to "), F.when(F.size("holders") == 0, "someone").otherwise(F.array_join("holders", ", ")), F.lit(", not known to "), F.array_join("missing", ", "), F.lit("."))
    hidden = private.groupBy("request_id", F.array_sort("holders").alias("holders"), F.array_sort("missing").alias("missing")).agg(F.min("n").alias("n"))
    hidden = hidden.withColumn("text", text).withColumn("kind", F.lit("secret"))
    plain = lines.filter(F.size("missing") == 0).select("request_id", "holders", "missing", "n", "text", "kind")
    return plain.unionByName(hidden)


def leaks(texts: DataFrame, secrets: DataFrame, least: float = 0.7) -> DataFrame:
    """texts (conv_id, ref, text) that repeat an open secret of their conversation (conv_id, secret)."""
    from ..functions.text import span_reuse

    met = texts.join(secrets, "conv_id").withColumn("reuse", span_reuse(F.col("secret"), F.col("text")))
    return met.groupBy("conv_id", "ref").agg(F.max("reuse").alias("reuse")).filter(F.col("reuse") >= least)


def audit(lines: DataFrame, replies: DataFrame, least: float = 0.5) -> DataFrame:
    """lines (trace_id, conv_id, upto, ref, text, placed, hidden) against the reply after the trace: echoed, possible_leak."""
    from ..functions.text import span_reuse

    columns = ["trace_id", "ref", "text", "placed", "hidden"]
    after = replies.select("conv_id", F.col("position").alias("at"), F.lit(1).alias("turn_of"), F.col("text").alias("reply"), *[F.lit(None).cast(dict(lines.dtypes)[c]).alias(c) for c in columns])
    asked = lines.select("conv_id", F.col("upto").alias("at"), F.lit(0).alias("turn_of"), F.lit(None).cast("string").alias("reply"), *columns)
    # Both in one window from the end of the chat: the last reply seen is the first one after a line's trace.
    w = Window.partitionBy("conv_id").orderBy(F.desc("at"), "turn_of").rowsBetween(Window.unboundedPreceding, -1)
    first = asked.unionByName(after).withColumn("reply", F.last("reply", ignorenulls=True).over(w)).filter("turn_of = 0 and reply is not null")
    echo = span_reuse(F.col("text"), F.col("reply")) >= least
    return first.select("trace_id", "ref", "placed", echo.alias("echoed"), (echo & F.col("hidden")).alias("possible_leak"))
