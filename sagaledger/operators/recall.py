"""The whole answer to a request: routes over the chat's messages, its facts and threads, one ordered list, one packet, a trace.

Everything is keyed by the request and its conversation, so a batch of requests is one plan and meets each chat once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords
from ..session import held
from . import packing, retrieval
from .state import asked_keys

#: How many excerpts, scenes, state lines and members of the cast go to the packet at most.
EXCERPTS, SCENES, STATES, CAST = 12, 2, 12, 6


@dataclass
class Memory:
    """What a chat remembers beside its messages; any part may be absent.

    facts: conv_id, id, predicate, names, text, position, missing (members of the scene who do not know it); threads: conv_id,
    id, kind, by, to, text, turn, status; vectors: conv_id, rev_id, position, embedding, one row a chunk; history: conv_id,
    old_value, new_value, turn; story: conv_id, text, the one in force; scenes: conv_id, window, text, those in force; state:
    conv_id, key, value, position, the latest value of each key; cast: conv_id, id, names, text, a line for each.
    """

    facts: DataFrame | None = None
    threads: DataFrame | None = None
    vectors: DataFrame | None = None
    history: DataFrame | None = None
    story: DataFrame | None = None
    scenes: DataFrame | None = None
    state: DataFrame | None = None
    cast: DataFrame | None = None


def vector_route(requests: DataFrame, vectors: DataFrame, least: float = retrieval.VECTOR_MIN, limit: int = retrieval.CANDIDATES) -> DataFrame:
    """(request_id, rev_id, position, sim, rank): messages of a request's chat by the exact cosine of their best chunk."""
    asked = requests.filter("embedding is not null").select("request_id", "conv_id", F.col("embedding").alias("_q"))
    near = asked.join(vectors, "conv_id").withColumn("sim", retrieval.cosine(F.col("embedding"), F.col("_q"))).filter(F.col("sim") >= least)
    best = near.groupBy("request_id", "rev_id").agg(F.max("sim").alias("sim"), F.max("position").alias("position"))
    return retrieval.ranked(best, "sim", limit)


def candidates(requests: DataFrame, corpus: DataFrame | retrieval.Index, memory: Memory) -> DataFrame:
    """(request_id, rev_id, rrf, signals) of all routes that the memory allows, fused by reciprocal rank.

    All text routes read one stored index.
    """
    corpus = retrieval.index_of(corpus)
    found = held(retrieval.keyword_route(requests, corpus))  # the particle route fills what it leaves
    routes = {"lexical": retrieval.lexical(requests, corpus), "keyword": found}
    w = Window.partitionBy("request_id").orderBy(F.desc("position"), "rev_id")
    routes["particle"] = retrieval.particle_route(requests, corpus, found).withColumn("rank", F.row_number().over(w))
    if memory.vectors is not None:
        routes["vector"] = vector_route(requests, memory.vectors)
    return retrieval.fuse({name: rows.withColumn("strong", F.lit(True)) for name, rows in routes.items()})


def standing(asked: DataFrame, requests: DataFrame, memory: Memory) -> list[DataFrame]:
    """Lines (request_id, kind, ref, text, head, private, score) of what a chat holds whatever is asked: the story, the newest
    scenes, its state, and of its cast those whom the message or the reply before it names.

    State keys that the message names come first, then the latest set.
    """

    def line(rows: DataFrame, kind: str, ref: Column, text: Column, score: Column) -> DataFrame:
        return rows.select("request_id", F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), text.alias("text"), F.lit(None).cast("string").alias("head"), F.lit(False).alias("private"), score.cast("double").alias("score"))

    def best(rows: DataFrame, order: list, most: int) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).filter(F.col("_n") <= most)

    out = []
    if memory.story is not None:
        out.append(line(asked.join(memory.story.select("conv_id", "text"), "conv_id"), "story", F.lit("story"), F.col("text"), F.lit(1)))
    if memory.scenes is not None:
        newest = memory.scenes.withColumn("_w", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("window")))).filter(F.col("_w") <= SCENES)
        out.append(line(asked.join(newest.select("conv_id", "window", "text"), "conv_id"), "lead", F.concat(F.lit("scene "), "window"), F.col("text"), F.col("window")))
    if memory.state is not None:
        rows = asked.join(memory.state.select("conv_id", "key", "value", "position"), "conv_id").withColumn("_asked", asked_keys(F.col("query"), F.col("key")))
        rows = best(rows, [F.desc("_asked"), F.desc("position"), "key"], STATES)
        out.append(line(rows, "state", F.col("key"), F.concat_ws(": ", "key", "value"), -F.col("_n")))
    if memory.cast is not None:
        rows = retrieval.named_pairs(requests, memory.cast, F.col("names")).join(memory.cast.select("id", "names", "text"), "id").join(requests.select("request_id", "query", "reply"), "request_id")
        rows = rows.withColumn("_m", retrieval.mention_score(F.col("names"), F.col("query"), F.col("reply"))).filter("_m > 0")
        out.append(line(best(rows, [F.desc("_m"), "id"], CAST), "cast", F.col("id"), F.col("text"), F.col("_m")))
    return out


def gather(requests: DataFrame, corpus: DataFrame, memory: Memory, budget: int = 400) -> DataFrame:
    """(request_id, n, budget, kind, ref, text, head, private, score): the lines that a packet may hold, best first in each kind.

    Excerpts that repeat a value which a later statement has replaced are left out.
    """
    requests = held(requests.withColumn("words", keywords("query")))
    asked = requests.select("request_id", "conv_id", "query", "words")
    hits = held(candidates(requests, corpus, memory)).join(corpus, "rev_id").join(asked.drop("conv_id"), "request_id")
    if memory.history is not None:
        told = hits.select("request_id", "conv_id", "rev_id", F.col("position").alias("turn"), "text")
        hits = hits.join(retrieval.not_replaced(told, memory.history).select("request_id", "rev_id"), ["request_id", "rev_id"], "left_semi")
    top = Window.partitionBy("request_id").orderBy(F.desc("rrf"), F.desc("position"), "rev_id")
    hits = hits.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= EXCERPTS)
    hits = hits.withColumn("text", retrieval.excerpt("text", "query", "words"))
    none, plain = F.lit(None).cast("string"), F.lit(False)
    line = lambda df, kind, ref, score, head=none, private=plain: df.select("request_id", F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), "text", head.alias("head"), private.alias("private"), score.cast("double").alias("score"))
    lines = line(hits, "excerpt", F.col("rev_id"), F.col("rrf"))
    quoted = retrieval.quote_lines(requests, corpus).withColumnRenamed("quote", "text")
    lines = lines.unionByName(line(quoted, "quote", F.concat_ws("#", "rev_id", "start"), F.col("score")))
    if memory.facts is not None:
        facts = retrieval.relevant_facts(requests, memory.facts.select("conv_id", "id", "predicate", "names", "text", "position"))
        facts = facts.join(asked, "request_id").join(memory.facts.select("conv_id", "id", "text", "missing"), ["conv_id", "id"])
        lines = lines.unionByName(line(facts, "fact", F.col("id"), F.col("score"), private=F.size(F.coalesce("missing", F.array())) > 0))
    if memory.threads is not None:
        threads = retrieval.relevant_threads(requests, memory.threads).join(asked, "request_id").join(memory.threads.select("conv_id", "id", "kind", "text"), ["conv_id", "id"])
        lines = lines.unionByName(line(threads.withColumn("text", F.concat("kind", F.lit(": "), "text")).drop("kind"), "thread", F.col("id"), 100 * F.col("mention") - F.col("rank")))
    for rows in standing(asked, requests, memory):
        lines = lines.unionByName(rows)
    place = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(i)) for i, kind in enumerate(packing.ORDER)])
    order = Window.partitionBy("request_id").orderBy(place, F.desc("score"), "ref")
    return lines.withColumn("n", F.row_number().over(order)).withColumn("budget", F.lit(budget))


def retrieve(requests: DataFrame, corpus: DataFrame, memory: Memory, budget: int = 400, policy: str = packing.DEFAULT_POLICY) -> DataFrame:
    """The packet's ledger: (request_id, n, kind, ref, tok, placed, why)."""
    return packing.pack(gather(requests, corpus, memory, budget), policy)


def trace(ledger: DataFrame) -> DataFrame:
    """(request_id, kind, offered, placed, tokens): what a request was offered and what its packet holds."""
    return ledger.groupBy("request_id", "kind").agg(F.count(F.lit(1)).alias("offered"), F.count_if("placed").alias("placed"), F.sum(F.when(F.col("placed"), F.col("tok")).otherwise(0)).cast("bigint").alias("tokens"))
