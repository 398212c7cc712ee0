"""Cross-tokenizer alignment of a byte-level vocabulary (A) with a piece vocabulary (B) on the same bytes.

Python turns a text into token ids and the byte offsets where tokens end, and nothing else; texts are cut into units there, and
equal units share one call of the libraries.  From there on everything is
array functions of Spark.  The ends that both sides share, by ``array_intersect``, cut the tokens into groups, most of which have
one token of either side.  Only the ends that one side alone has, by ``array_except``, are looked at one by one: one sort among
all ends tells how many ends of either side stand before each.  Those without a shared end between them are one group of more
than two tokens; what lies between two such groups is a run of groups of one token of either side, taken by their places.  A link is
one stretch between two neighbouring ends of either side, and so belongs to one token of each.  No array is searched and none
is grown step by step, so the work on a text is that of a sort.

How many documents hold an id pair linked is a count over the whole corpus.  The distinct pairs of each document are stored
once; the counts come from one aggregation, and go back to the documents by a join in which the pairs that are in a great
share of all rows, which are few by that, are broadcast, and all others meet in a shuffle.

Defined results: a null or empty text, and one whose bytes are not those of its tokens (B writes U+2581 for a space, so a text
that has one is such), has no tokens, hence zeros and an empty hash; rows that repeat a doc_id are separate documents; a null
doc_id stays null; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound
from ._bpe import SPACE, WHITE, UnitEncoder, kinds, plain_encoder
from ._bpe import TEXT as RARE
from ._frames import in_batches, joined_by_group, stored
from ._text import Texts, release, steps
from .pieces import BYTE, MARK, NORMAL, USER, Normaliser, read_model

#: Bytes of text that are tokenised at a time.
STEP_BYTES = 2 << 20

_INTS = T.ArrayType(T.IntegerType(), False)
_LONGS = T.ArrayType(T.LongType(), False)
TOKENS = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), *(T.StructField(c, kind, False) for c, kind in (("a_ids", _INTS), ("a_ends", _LONGS), ("b_ids", _INTS), ("b_ends", _LONGS)))])


class PieceTokens:
    """The sentencepiece library, the bytes of every id, and whether texts may be cut."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = read_model(path)
        self.names = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"" for p, _, kind in spec.pieces]
        self.sizes = np.array([len(n) for n in self.names], np.int32)
        self.cuts = Normaliser(spec).plain and not any("\n" in p or MARK in p.lstrip(MARK) for p, _, kind in spec.pieces if kind != BYTE)

    def encode(self, units: list[bytes]) -> list[list[int]]:
        """Ids of units, each with a space in front, which the library writes itself, or a line end, before which that space is one
        too many; none where their bytes are not those of the unit."""
        found = self.library.encode([u.decode().removeprefix(" ") for u in units], num_threads=1)
        found = [i if u[:1] == b" " else i[1:] for u, i in zip(units, found)]
        return [i if b"".join(map(self.names.__getitem__, i)) == u else [] for u, i in zip(units, found)]


class BothTokens(UnitEncoder):
    """Ids of A and B of texts with a space before each; those of A are raised by _A, so that one row of ids holds both.

    A text is cut before a space or a line end that stands alone between other characters.  The pattern of A ends a token on
    either side of these, whatever stands further.  Where the model of B rewrites nothing but spaces, and has no piece in which a
    space or a line end follows another character, no merge of B reaches over such a place either; so the ids of a text are
    those of its units, and equal units share one call of the libraries.  Texts with white space of a rare kind, and all texts
    of other vocabularies, are encoded whole.
    """

    dtype = np.dtype("<i4")
    cache_bytes = 64 << 20

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = plain_encoder(byte_path), PieceTokens(piece_path)
        self.cuts = self.b.cuts and not self.a.added
        self._clear()

    def odd(self, texts: Texts) -> np.ndarray:
        out = np.full(len(texts), not self.cuts)
        if self.cuts:
            out[np.searchsorted(texts.offsets, np.flatnonzero(kinds(texts.data) == RARE), side="right") - 1] = True
        return out

    def cut(self, texts: Texts) -> np.ndarray:
        data, offsets = texts.data, texts.offsets
        if not len(data):
            return np.zeros(0, np.int64)
        kind = kinds(data)
        dark = (kind != SPACE) & (kind != WHITE)
        begin = np.zeros(len(data), dtype=bool)
        begin[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & dark[:-2] & dark[2:]
        full = offsets[:-1] < offsets[1:]
        begin[offsets[1:][full] - 1] = False
        begin[offsets[:-1][full]] = True
        return np.flatnonzero(begin)

    def units(self, raw: list[bytes]) -> list[list[int]]:
        ids, at = self.a.encode(pa.array(raw, pa.large_binary()).cast(pa.large_string()))
        ids, at = (ids.astype(np.int32) + _A).tolist(), at.tolist()
        return [b + ids[s:e] for b, s, e in zip(self.b.encode(raw), at, at[1:])]

    def whole(self, text: str) -> list[int]:
        return self.units([text.encode()])[0] if text else []

    def both(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts in a row, offsets of each text's) of A and of B.  A text has none where B's bytes are not its own:
        no unit has more bytes by B than of its own, and one with other bytes has none."""
        ids, at = self.encode(column)
        of_a = ids >= _A
        size = np.concatenate([[0], np.cumsum(self.b.sizes[np.where(of_a, 0, ids)] * ~of_a, dtype=np.int64)])[at]
        same = np.repeat(np.diff(size) == pc.binary_length(column).to_numpy(zero_copy_only=False), np.diff(at))
        return [(ids[own] - base, np.concatenate([[0], np.cumsum(own)])[at]) for own, base in ((of_a & same, _A), (~of_a & same, 0))]


#: What raises ids of A above those of B.
_A = np.int32(1 << 24)
_both: dict[tuple[str, str], BothTokens] = {}


def _both_tokens(byte_path: str, piece_path: str) -> BothTokens:
    if (byte_path, piece_path) not in _both:
        _both[byte_path, piece_path] = BothTokens(byte_path, piece_path)
    return _both[byte_path, piece_path]


def _ends(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running byte ends of the tokens of each text, times four, which leaves bits for marks; at is where each text's tokens
    begin."""
    total = np.cumsum(sizes, dtype=np.int64)
    before = np.concatenate([[0], total])[at[:-1]]
    return (total - np.repeat(before, np.diff(at))) * 4


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind), type=pa.list_(pa.field("element", kind, nullable=False)))


def tokens(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(row, doc_id, a_ids, a_ends, b_ids, b_ends) of every row of docs; row numbers the rows, whatever their ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _both_tokens(byte_path, piece_path)
        row = TaskContext.get().partitionId() << 40
        large = pa.large_string()
        none = pa.scalar("", large)
        for batch in batches:
            for low, high, _ in steps(batch.column("text"), STEP_BYTES):
                n = high - low
                texts = pc.fill_null(batch.column("text").slice(low, n).cast(large), "")
                spaced = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(pa.scalar(" ", large), texts, none))
                (a_ids, a_at), (b_ids, b_at) = made.both(spaced)
                columns = [pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(low, n), _lists(a_ids, a_at, pa.int32()), _lists(_ends(made.a.sizes[a_ids], a_at), a_at, pa.int64()), _lists(b_ids, b_at, pa.int32()), _lists(_ends(made.b.sizes[b_ids], b_at), b_at, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=TOKENS.names)
                row += n
        release()

    rows = in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, TOKENS)


#: Bits of an id of B in a pair; the bit of B's side in a key of an end that one side alone has, above the index.
_ID, _SIDE = 20, 1 << 30


def _with(names: tuple[str, ...], then: Callable[..., Column], *have: Column) -> Column:
    """then of these columns, each bound once for a row."""
    return bound(F.col(names[0]), lambda v: _with(names[1:], then, *have, v)) if names else then(*have)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_odd(found: DataFrame) -> DataFrame:
    """Token rows with n_shared (how many ends both sides have) and, for each end that one side alone has, odd (its place among
    all ends), keys (end, side, index among those of its side), a_at and b_at (how many ends of either side stand before it)."""
    shared = F.array_intersect("a_ends", "b_ends")
    rows = found.select("*", shared.alias("shared"), F.array_except("a_ends", "b_ends").alias("a_only"), F.array_except("b_ends", "a_ends").alias("b_only"))
    marked = lambda side: F.transform(side, lambda e: e + 1)
    key = lambda side, bit: F.transform(side, lambda e, w: F.shiftleft(e, 30) + (w + F.lit(bit)))
    rows = rows.select("*", F.sort_array(F.concat("shared", marked("a_only"), marked("b_only"))).alias("all"), F.sort_array(F.concat(key("a_only", 0), key("b_only", _SIDE))).alias("keys"))
    one = F.lit(1).cast("bigint")
    odd = _with(("all",), lambda all_: F.filter(_upto(F.size("all")), lambda k: F.get(all_, k).bitwiseAND(one) == one))
    rows = rows.select("*", odd.alias("odd"), F.size("shared").alias("n_shared")).drop("shared", "a_only", "b_only", "all")
    # how many ends of A alone stand before place u of keys: its index if A has that end, else u without B's index
    index = lambda x: x.bitwiseAND(F.lit(2 * _SIDE - 1)).cast("int")
    rows = rows.withColumn("before", F.transform(F.transform("keys", index), lambda x, u: F.when(x < _SIDE, x).otherwise(u + _SIDE - x)))
    a_at = _with(("before",), lambda before: F.transform("odd", lambda k, u: k - u + F.get(before, u)))
    b_at = F.zip_with("odd", "before", lambda k, n: k - n)
    return rows.select("*", a_at.alias("a_at"), b_at.alias("b_at")).drop("before")


def with_runs(rows: DataFrame) -> DataFrame:
    """Rows of with_odd with groups (of more than two tokens: their first and last token on either side) and runs (where the
    groups of one token of either side between them begin, and how many they are)."""
    next_to = lambda k: _with(("odd",), lambda odd: F.filter(_upto(F.size("odd")), lambda u: ~F.get(odd, u + k).eqNullSafe(F.get(odd, u) + k)))
    rows = rows.select("*", next_to(-1).alias("first"), next_to(1).alias("last"))

    def groups(keys: Column, a_at: Column, b_at: Column, first: Column, last: Column) -> Column:
        def group(u: Column, g: Column) -> Column:
            v = F.get(last, g)
            of_b = F.when(F.get(keys, v).bitwiseAND(F.lit(_SIDE)) != 0, 1).otherwise(0)
            return F.struct(F.get(a_at, u).alias("a"), F.get(b_at, u).alias("b"), (F.get(a_at, v) + 1 - of_b).alias("a_last"), (F.get(b_at, v) + of_b).alias("b_last"))

        return F.transform(first, group)

    rows = rows.withColumn("groups", _with(("keys", "a_at", "b_at", "first", "last"), groups))

    def runs(groups: Column) -> Column:
        def run(g: Column) -> Column:
            a, b = (F.coalesce(F.get(groups, g - 1)[c] + 1, F.lit(0)) for c in ("a_last", "b_last"))
            return F.struct(a.alias("a"), b.alias("b"), (F.coalesce(F.get(groups, g)["a"], F.size("a_ids")) - a).alias("n"))

        return F.transform(F.sequence(F.lit(0), F.size(groups)), run)

    return rows.withColumn("runs", _with(("groups",), runs))


def _pair(x: Column, y: Column) -> Column:
    """Two ids as one number.  The coalesce has no null to replace; it tells Spark so, and arrays without nulls are sorted as
    plain numbers."""
    return F.coalesce(F.shiftleft(x.cast("bigint"), _ID) + y, F.lit(0).cast("bigint"))


def _of_a(run: Column) -> Column:
    """The places of a run's tokens of A; null for an empty run."""
    return F.when(run["n"] > 0, F.sequence(run["a"], run["a"] + run["n"] - 1))


def links() -> Column:
    """Pairs of ids, one for each overlap of a token of A with one of B: of groups of two tokens, and in the others at every end
    that one side alone has and at the shared end."""

    def plain(runs: Column, a: Column, b: Column) -> Column:
        pairs = lambda r: F.transform(_of_a(r), lambda i: _pair(F.get(a, i), F.get(b, i + (r["b"] - r["a"]))))
        return F.flatten(F.filter(F.transform(runs, pairs), lambda x: x.isNotNull()))

    def rest(a_at: Column, b_at: Column, a: Column, b: Column) -> Column:
        return F.transform(a_at, lambda i, u: _pair(F.get(a, i), F.get(b, F.get(b_at, u))))

    def closing(groups: Column, a: Column, b: Column) -> Column:
        return F.transform(groups, lambda g: _pair(F.get(a, g["a_last"]), F.get(b, g["b_last"])))

    return F.concat(_with(("runs", "a_ids", "b_ids"), plain), _with(("a_at", "b_at", "a_ids", "b_ids"), rest), _with(("groups", "a_ids", "b_ids"), closing))


def groups_text() -> Column:
    """The groups as text, of the ids as texts in a_texts and b_texts: ids of A, a bar, ids of B; groups one after another."""

    def pieces(runs: Column, groups: Column, a: Column, b: Column) -> Column:
        def piece(r: Column, k: Column) -> Column:
            plain = F.transform(_of_a(r), lambda i: F.concat(F.get(a, i), F.lit("|"), F.get(b, i + (r["b"] - r["a"]))))
            g = F.get(groups, k)
            ids = lambda side, c: F.array_join(F.transform(F.sequence(g[c], g[f"{c}_last"]), lambda i: F.get(side, i)), ",")
            return F.array(F.array_join(plain, ";"), F.when(g.isNotNull(), F.concat(ids(a, "a"), F.lit("|"), ids(b, "b"))))

        return F.flatten(F.transform(runs, piece))

    # array_join leaves out nulls: empty runs, and the group that does not follow the last run
    return F.array_join(_with(("runs", "groups", "a_texts", "b_texts"), pieces), ";")


def linked(found: DataFrame) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): pairs are the distinct id pairs of a row, and
    times how often each is linked there."""
    rows = with_runs(with_odd(found))
    rows = rows.select("*", *(F.col(f"{side}_ids").cast("array<string>").alias(f"{side}_texts") for side in "ab"))
    rows = rows.select("row", "doc_id", F.size("a_ids").cast("bigint").alias("n_a"), F.size("b_ids").cast("bigint").alias("n_b"), F.col("n_shared").cast("bigint").alias("n_groups"),
        F.when(F.size("a_ids") > 0, F.sha2(groups_text(), 256)).otherwise("").alias("groups_sha256"), F.sort_array(links()).alias("links"))
    places = F.when(F.size("links") > 0, F.sequence(F.lit(0), F.size("links") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("firsts", _with(("links",), lambda links: F.filter(places, lambda k: ~F.get(links, k).eqNullSafe(F.get(links, k - 1)))))
    times = _with(("firsts",), lambda firsts: F.transform(firsts, lambda k, r: F.coalesce(F.get(firsts, r + 1), F.size("links")) - k))
    pairs = _with(("links",), lambda links: F.transform("firsts", lambda k: F.get(links, k)))
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("bigint").alias("n_links"), "groups_sha256", pairs.alias("pairs"), times.alias("times"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n_docs, best): in how many rows a pair is linked, and whether no pair of the same id of A is in more."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pairs")
    a = F.shiftright("pair", _ID).alias("a")
    most = counts.groupBy(a).agg(F.max("n_docs").alias("most"))
    return counts.select("*", a).join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("int").alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row for each row of docs: numbers of tokens, groups and links, how many links are among the most frequent of their
    id of A, the sum of the links' counts, and the hash of the groups."""
    rows = stored(linked(tokens(docs, byte_path, piece_path)), "linked")
    counts = stored(pair_counts(rows), "counts")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_")).select("row", F.col("_.pairs").alias("pair"), F.col("_.times").cast("bigint").alias("times"))
    met = joined_by_group(each, counts, ["pair"], "n_docs")
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
