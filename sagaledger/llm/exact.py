"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is normalised (each run of white space becomes one space) and cut into blocks of a fixed number of bytes.  The
distinct blocks are sorted and numbered: a block's name is an integer, equal for equal blocks and for no others.  Then
adjacent names are paired, the distinct pairs are sorted and numbered in the same way, and so on until one name is left: the
document's identity, equal for two documents exactly when their normalised texts are equal.

The order of the blocks is by a 64-bit number computed from the content first and by the content itself where two contents
share the number.  So only the numbers need to be sorted and joined, unless ``shared_numbers``, which compares the least and
the greatest content of every number, finds one with two contents; those contents are sorted and joined as they are.  Pairs
are sorted by their two names.  No name depends on digests being free of collisions.

Work and skew: the texts are shuffled once, after each task has reduced the blocks of a number to two; what is sorted, joined
and paired above them are integers, and their number halves with each level.  Numbers and pairs are counted where they lie
before they are sorted, and names come back by ``joined_by_group``, so a block that a third of the corpus shares goes into no
single task.

Defined results: a null text counts as an empty one; empty texts equal each other; of equal rows (same doc_id, same text)
one stays; null ids come after all others, and a group with null ids only keeps one row and has a null keep_id; an empty
table gives an empty result; columns other than doc_id and text are carried by ``drop_copies`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import discard, joined_by_group, stored, unused_name

#: Bytes in a block.
BLOCK_BYTES = 4096

#: Runs of these characters count as one space (fixed values).
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def _number(content: Column, bits: int) -> Column:
    number = F.xxhash64(content)
    return number if bits == 64 else F.pmod(number, F.lit(1 << bits))


def shared_numbers(contents: DataFrame) -> DataFrame:
    """(number, n, shared) of (number, content): how many blocks have the number, and whether they differ."""
    ends = contents.groupBy("number").agg(F.min("content").alias("least"), F.max("content").alias("greatest"), F.count(F.lit(1)).alias("n"))
    return ends.select("number", "n", (F.col("least") != F.col("greatest")).alias("shared"))


def named(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys, which are distinct in the columns by, with an integer name each: their place in the sorted order.

    The sort is by ranges, and a name is the range's number and the place in it; stored, so that every reader sees one name.
    """
    return stored(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, number_bits: int = 64) -> DataFrame:
    """(row_id, doc_id, sha, level, name): the last two are the document's identity, sha the text's SHA-256.

    row_id numbers the rows; the result is read from files in the shared folder, so it stays the same for every reader.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("text"),
    )
    raw = F.col("text").cast("binary")
    last = F.greatest(F.ceil(F.octet_length("text") / F.lit(block_bytes)).cast("int"), F.lit(1)) - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    numbers = F.transform(blocks, lambda b: _number(b, number_bits))
    slim = stored(rows.select("row_id", "doc_id", sha, numbers.alias("numbers")), "rows")
    each = rows.select(F.explode(blocks).alias("content")).withColumn("number", _number(F.col("content"), number_bits))
    seen = stored(shared_numbers(each), "numbers")
    place = slim.select("row_id", "doc_id", "sha", F.posexplode("numbers").alias("pos", "number"), F.size("numbers").alias("n"))
    if seen.filter("shared").isEmpty():
        names = named(seen.drop("shared").withColumnRenamed("n", "rows"), ["number"])
        state = joined_by_group(place, names, ["number"], "rows")
    else:
        # The row_ids of the texts must be those of one reading, so the texts are stored with them.
        full = stored(rows, "rows")
        place = full.select("row_id", "doc_id", sha, F.posexplode(blocks).alias("pos", "content"), (last + 1).alias("n")).withColumn("number", _number(F.col("content"), number_bits))
        some = place.join(seen.filter("shared").select("number"), "number", "left_semi")
        several = some.groupBy("number", "content").count().withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy("content")))
        several = stored(several.select("number", "content", "rank", F.col("count").alias("rows")), "ranks")
        ranks = place.join(several.select("number", "content", "rank"), ["number", "content"], "left").select("row_id", "doc_id", "sha", "pos", "n", "number", F.coalesce("rank", F.lit(1)).alias("rank"))
        keys = seen.filter("not shared").select("number", F.lit(1).alias("rank"), F.col("n").alias("rows")).unionByName(several.select("number", "rank", "rows"))
        names = named(keys, ["number", "rank"])
        state = joined_by_group(ranks, names, ["number", "rank"], "rows")
    state = stored(state.select("row_id", "doc_id", "sha", "pos", "n", "name"), "state")
    done, level = [], 0
    while True:
        done.append(state.filter("n = 1").select("row_id", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        more = state.filter("n > 1")
        if more.isEmpty():
            break
        side = lambda at: F.max(F.when(F.col("pos") % 2 == at, F.col("name")))
        pairs = more.groupBy("row_id", "doc_id", "sha", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n"))
        # A last name without a neighbour is paired with -1, which names nothing.
        pairs = stored(pairs.agg(side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right")), "pairs")
        names = named(pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("rows")), ["left", "right"])
        state = stored(joined_by_group(pairs, names, ["left", "right"], "rows").select("row_id", "doc_id", "sha", "pos", "n", "name"), "state")
        discard(pairs)
        discard(names)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, number_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The groups are summed up before the shuffle and joined back on the identity, hot ones by a bounded broadcast.
    """
    each = identities(docs, block_bytes, number_bits)
    key = ["level", "name"]
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id")
    summed = stored(each.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    return joined_by_group(each, summed, key, "group_size").select(
        "doc_id",
        F.col("first")["doc_id"].alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("first")["row_id"]).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Kept rows are known by doc_id and text; of rows that share both, the last step leaves one.  It needs no shuffle of its
    own, for the join has brought them together.
    """
    sha = unused_name(docs, "sha")
    keep = groups(docs, block_bytes).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    rows = docs.withColumn(sha, F.sha2(normalised(docs["text"]), 256))
    met = rows["doc_id"].cast("bigint").eqNullSafe(keep["keep_id"]) & (rows[sha] == keep["keep_sha"])
    return rows.join(keep, met, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)
