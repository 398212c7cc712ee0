"""Near-duplicate detection: HyperMinHash registers in bands, then confirmation on the full sets.

1.  One pass over the texts computes every document's set of word shingles, an identity of the set, and from its
    HyperMinHash registers one key per band.  Documents with equal sets have equal identities; from here on a set is one
    node, however many copies it has.  An identity is a 64-bit sum over the set; a second, independent sum is held against it,
    and sets that share the first but not the second are told apart, so 128 bits decide that sets are equal.
2.  Keys that two different sets share make candidates.  They are found by a grouped minimum and maximum, so a key that a
    third of the corpus has is reduced before the shuffle.  Sets that are connected by shared keys form a family; every
    link must lie inside a family.
3.  A second pass over the texts takes out the sets of the families' members (a Bloom filter of fixed size lets the other
    documents pass by; a join afterwards is exact).
4.  Families are compared in blocks of bounded size.  A family of more than one chunk is dealt into classes by the size of its
    sets, so that sets of classes that are not neighbours are too unlike in size to be linked, and a class into chunks; a
    group is one chunk, or two chunks of which each set of one is held against each of the other.  Inside a group the
    collision-corrected estimate from the registers picks the pairs that can reach the threshold, and a pair is a link if the
    full sets say so.  Pairs that earlier links of the group already connect are not looked at again.  A group returns a
    spanning set of links, never its pairs.
5.  Connected components of the links, joined back to the sets and then to the documents, hot ones by a bounded broadcast.

The chance that a pair at the threshold of 0.8 shares none of the 42 bands of six registers is 3 in a million for sets that
fill the registers.  The bound under which an estimate rules a pair out lies five standard deviations below the threshold.

Cost in a family: each set is shipped once for every chunk of its own class and the two beside it, and held against their sets.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle has one shingle, the whole; rows that repeat a doc_id are one document with several sets, each kept
or not by its own component; rows with a null doc_id belong to the component of their set and are kept only if no row there has
an id; an empty table gives an empty result; columns other than doc_id and text are carried by ``drop_near_copies`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import discard, in_batches, joined_by_group, stored, unused_name
from ._text import NOT_SPACE, Texts, Words, buffers, mix64, release, steps
from .components import components
from .sketch import REGISTERS, band_keys, estimated_jaccard, registers

#: Words in a shingle, and the similarity of a link in percent.
SHINGLE_WORDS, PERCENT = 5, 80
BANDS, WIDTH = 42, 6
#: Sets in a chunk of a family.
CHUNK = 512
#: Bits of the Bloom filters, whatever the input's size: 8 MB.
BLOOM_BITS = 1 << 26


def shingle_sets(texts: Texts, words_in: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): the sorted distinct shingle hashes of text i are elements[first[i]:first[i + 1]]."""
    words = Words(texts.lowered(), NOT_SPACE)
    h, first = words.hashes(), words.first
    n = max(len(h) - words_in + 1, 0)
    rolled = np.full(n, words_in, dtype=np.uint64)
    for k in range(words_in):
        rolled = mix64(rolled * np.uint64(0x100000001B3) + h[k : k + n])
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s >= words_in:
            x = np.sort(rolled[s : e - words_in + 1])
            if len(x) > 1:
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif e > s:
            x = np.full(1, e - s, dtype=np.uint64)
            for k in range(s, e):
                x = mix64(x * np.uint64(0x100000001B3) + h[k : k + 1] + np.uint64(1))
        else:
            x = rolled[:0]
        out.append(x)
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


_SUMS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xA0761D6478BD642F))


def identities(elements: np.ndarray, first: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over the elements of each set; 0 for an empty set.  bits is less for tests only."""
    size, out = np.diff(first), []
    for salt, keep in zip(_SUMS, (bits, 64)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(elements ^ salt), dtype=np.uint64)])
        mixed = mix64(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)) >> np.uint64(64 - keep)
        out.append(np.where(size > 0, mixed, 0).astype(np.uint64).view(np.int64))
    return out[0], out[1]


def _input(docs: DataFrame) -> DataFrame:
    return in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketched(docs: DataFrame, words_in: int, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, sid, check, keys) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in steps(batch.column("text")):
                elements, first = shingle_sets(texts, words_in)
                keys = band_keys(registers(elements, first), BANDS, WIDTH)
                size = np.diff(first)
                has = size > 0
                at = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(size), *map(pa.array, identities(elements, first, bits)), lists], names=["doc_id", "n_shingles", "sid", "check", "keys"])
        release()

    return _input(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, sid bigint, check bigint, keys array<bigint>")


def clashing(sketches: DataFrame) -> DataFrame | None:
    """The identities that different sets share; None if there are none, as is usual."""
    ends = sketches.groupBy("sid").agg(F.min("check").alias("least"), F.max("check").alias("most"))
    several = stored(ends.filter(F.col("least") != F.col("most")).select("sid"), "clashes")
    return None if several.isEmpty() else several


def told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows without the column check, and with an identity of both sums where the first alone is shared."""
    if clashes is None:
        return rows.drop("check")
    both = F.when(F.col("two"), F.xxhash64("sid", "check")).otherwise(F.col("sid"))
    return rows.join(clashes.withColumn("two", F.lit(True)), "sid", "left").withColumn("sid", both).drop("check", "two")


_TWO = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def bloom(numbers: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of a bigint column, as 64-bit words; its size does not depend on the input.

    Tasks turn numbers into words with bits set, the cluster joins equal words, and bits / 64 words at most come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy().view(np.uint64)
            at = np.concatenate([mix64(x ^ salt) & np.uint64(bits - 1) for salt in _TWO])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    got = numbers.mapInArrow(run, "word int, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    del got
    release()
    return out.view(np.uint64)


def may_contain(filter_: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64)
    hit = np.ones(len(x), dtype=bool)
    for salt in _TWO:
        at = mix64(x ^ salt) & np.uint64(len(filter_) * 64 - 1)
        hit &= (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return hit


def families(sketches: DataFrame) -> DataFrame:
    """(node, root): sets that shared keys connect, with the least set of their family."""
    spark = sketches.sparkSession
    every = sketches.select(F.explode("keys").alias("key"), "sid")
    ends = every.groupBy("key").agg(F.min("sid").alias("least"), F.max("sid").alias("most"), F.count(F.lit(1)).alias("rows"))
    shared = stored(ends.filter(F.col("least") != F.col("most")), "keys")
    # Two rows are just the two ends.  Keys with more rows may have sets in between, which a join gets.
    wide = shared.filter("rows > 2").select("key", "least")
    filter_ = spark.sparkContext.broadcast(bloom(wide.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy()
            owner = np.repeat(batch.column("sid").to_numpy(), np.diff(lists.offsets.to_numpy()))
            hit = may_contain(filter_.value, keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(owner[hit])], names=["key", "sid"])

    some = sketches.select("sid", "keys").mapInArrow(run, "key bigint, sid bigint")
    inner = some.join(wide, "key").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    return components(shared.select(F.col("least").alias("a"), F.col("most").alias("b")).unionByName(inner))


def _member_sets(docs: DataFrame, nodes: DataFrame, clashes: DataFrame | None, words_in: int, bits: int) -> DataFrame:
    """(sid, set) of every member of a family, once."""
    spark = docs.sparkSession
    filter_ = spark.sparkContext.broadcast(bloom(nodes.select("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            hit = may_contain(filter_.value, ids.fill_null(0).to_numpy()) | np.asarray(ids.is_null())
            batch = batch.filter(pa.array(hit))
            for _, _, texts in steps(batch.column("text")):
                elements, first = shingle_sets(texts, words_in)
                blobs = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((first * 8).astype(np.int32).tobytes()), pa.py_buffer(elements.tobytes())])
                yield pa.RecordBatch.from_arrays([*map(pa.array, identities(elements, first, bits)), blobs], names=["sid", "check", "set"])
        release()

    return told_apart(_input(docs).mapInArrow(run, "sid bigint, check bigint, set binary"), clashes).dropDuplicates(["sid"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def spanning_links(sids: list[int], sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever the links among all pairs of these sets connect; with sides, among pairs across them."""
    order = sorted(range(len(sids)), key=lambda i: (0 if side is None else int(side[i]), sids[i]))
    sids, sets = [sids[i] for i in order], [sets[i] for i in order]
    n = len(sids)
    before = np.arange(n) if side is None else np.full(n, int((side == 0).sum()))  # the sets that a set is held against
    size = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    rows = registers(np.concatenate(sets), first)
    group = np.arange(n)  # the component of each set; a merge renames the smaller one
    out = []
    for i in range(1 if side is None else int(before[0]), n):
        other = np.flatnonzero(group[: before[i]] != group[i])
        near = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        if not len(near):
            continue
        guess = estimated_jaccard(rows[near], rows[i][None, :], size[near], np.full(len(near), size[i]))
        used = np.maximum(np.minimum(np.maximum(size[near], size[i]), REGISTERS), 1)
        bound = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / used) - 0.02
        for k in np.argsort(-guess, kind="stable").tolist():
            if guess[k] < bound[k]:
                continue
            j = int(near[k])
            if group[j] != group[i] and _similar(sets[i], sets[j], percent):
                out.append((sids[i], sids[j]))
                group[group == group[i]] = group[j]
    return out


def placed(nodes: DataFrame, percent: int) -> DataFrame:
    """(sid, root, group, side) for each group that a member of a family belongs to; side is null in groups of one chunk.

    Sets whose sizes allow a link lie in one size class or in two neighbouring ones: a class is a little wider than the
    threshold's ratio.
    """
    width = 1.001 * float(np.log(max(100 / percent, 1.0001)))
    classed = nodes.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / F.lit(width)).cast("int"))
    counts = classed.groupBy("root", "class").agg(F.count(F.lit(1)).alias("m"))
    entry = F.struct("class", F.ceil(F.col("m") / F.lit(CHUNK)).cast("int"))
    # A root has as many entries as there are size classes: some hundred at most.
    chunks = stored(counts.groupBy("root").agg(F.sum("m").alias("m"), F.map_from_entries(F.collect_list(entry)).alias("chunks")), "chunks")
    dealt = joined_by_group(classed, chunks, ["root"], "m")
    own, many = F.col("class"), lambda c: F.coalesce(F.col("chunks")[c], F.lit(0))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("sid"), many(own)).cast("int"))
    k = F.col("chunk")

    def place(a: Column, i: Column, b: Column, j: Column, side: Column) -> Column:
        return F.struct(F.concat_ws(":", a, i, b, j).alias("group"), side.cast("int").alias("side"))

    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda o: o < n)  # noqa: E731  none for n = 0
    alone = F.array(place(own, k, own, k, F.lit(None)))
    beside = F.transform(F.filter(upto(many(own)), lambda o: o != k), lambda o: place(own, F.least(k, o), own, F.greatest(k, o), F.when(k < o, 0).otherwise(1)))
    above = F.transform(upto(many(own + 1)), lambda o: place(own, k, own + 1, o, F.lit(0)))
    below = F.transform(upto(many(own - 1)), lambda o: place(own - 1, o, own, k, F.lit(1)))
    small = F.array(place(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(None)))
    every = F.when(F.col("m") <= CHUNK, small).otherwise(F.concat(alone, beside, above, below))
    return dealt.select("sid", "root", F.explode(every).alias("at")).select("sid", "root", "at.group", "at.side")


def links(docs: DataFrame, nodes: DataFrame, clashes: DataFrame | None, words_in: int, percent: int, bits: int = 64) -> DataFrame:
    """(a, b) of sets whose similarity reaches the threshold: enough of them to connect all that are connected."""
    rows = placed(nodes, percent).join(_member_sets(docs, nodes, clashes, words_in, bits), "sid")

    def run(table: pa.Table) -> pa.Table:
        data, at = buffers(table["set"].combine_chunks())
        elements = np.frombuffer(data.tobytes(), dtype=np.uint64)
        sets = [elements[a:b] for a, b in zip((at[:-1] // 8).tolist(), (at[1:] // 8).tolist())]
        side = None if table["side"].null_count else table["side"].to_numpy()
        found = spanning_links(table["sid"].to_pylist(), sets, percent, side)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("root", "group").applyInArrow(run, "a bigint, b bigint")


def judged(docs: DataFrame, words_in: int, percent: int, bits: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, n_shingles, sid, component_id, kept) of every row, and the clashes of identities."""
    raw = stored(sketched(docs, words_in, bits), "sketches")
    clashes = clashing(raw)
    sketches = told_apart(raw, clashes) if clashes is None else stored(told_apart(raw, clashes), "sketches")
    some = sketches.filter("n_shingles > 0")
    sets = stored(some.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"), F.count(F.lit(1)).alias("rows")), "sets")
    nodes = stored(sets.join(families(sketches).withColumnRenamed("node", "sid"), "sid"), "families")
    roots = stored(components(links(docs, nodes, clashes, words_in, percent, bits)), "roots")
    known = stored(sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc_id", "rows", F.coalesce("root", "sid").alias("root")), "known")
    least = stored(known.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets")), "components")
    ends = stored(joined_by_group(known.select("sid", "rows", "root"), least, ["root"], "sets").select("sid", "rows", "component_id"), "ends")
    rows = sketches.select("doc_id", "n_shingles", "sid")
    out = joined_by_group(rows.filter("n_shingles > 0"), ends, ["sid"], "rows").select("doc_id", "n_shingles", "sid", "component_id")
    out = out.unionByName(rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    for done in (sets, nodes, roots, known, least):
        discard(done)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), clashes


def near_duplicates(docs: DataFrame, words_in: int = SHINGLE_WORDS, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    return judged(docs, words_in, percent, bits)[0].drop("sid")


def drop_near_copies(docs: DataFrame, words_in: int = SHINGLE_WORDS, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, row by row, with all their columns.

    A row is known by its doc_id and its set.  Where all rows of an id are kept or all go, the id says which; only for ids
    (and for rows without one) of which some rows stay and some go, the sets of their rows are computed again.
    """
    said, clashes = judged(docs, words_in, percent, bits)
    gone = said.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every")).filter("not every")
    gone = stored(gone.select(F.col("doc_id").alias("gone_id"), "some"), "gone")
    rest = docs.join(gone.select("gone_id"), docs["doc_id"].cast("bigint").eqNullSafe(F.col("gone_id")), "left_anti")
    mixed = gone.filter("some").select("gone_id")
    if mixed.isEmpty():
        return rest
    both = stored(docs.join(mixed, docs["doc_id"].cast("bigint").eqNullSafe(F.col("gone_id")), "left_semi"), "mixed")
    sid, check = unused_name(docs, "sid"), unused_name(docs, "check")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in steps(batch.column("text").cast(pa.string())):
                found = identities(*shingle_sets(texts, words_in), bits)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *map(pa.array, found)], names=[*batch.schema.names, sid, check])

    schema = T.StructType([*both.schema.fields, T.StructField(sid, T.LongType()), T.StructField(check, T.LongType())])
    again = both.mapInArrow(run, schema)
    if clashes is not None:
        two = F.xxhash64(sid, check)
        again = again.join(clashes.withColumnRenamed("sid", "_clash"), F.col(sid) == F.col("_clash"), "left").withColumn(sid, F.when(F.col("_clash").isNotNull(), two).otherwise(F.col(sid))).drop("_clash")
    stay = said.filter("kept").select(F.col("doc_id").alias("_stay_id"), F.col("sid").alias("_stay_sid")).distinct()
    met = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_stay_id")) & (F.col(sid) == F.col("_stay_sid"))
    return rest.unionByName(again.join(stay, met, "left_semi").select(*docs.columns))
