"""Phrases whose words stand together more often than chance, by sorted suffixes (suffix-sigma).

Every word of a piece of text begins a suffix of at most MAX_WORDS words.  The suffixes are shuffled by language and first word,
each task sorts what it gets in reverse lexicographic order, and one pass with a stack counts all their prefixes: a prefix is
pushed where a suffix does not share it with the one before, and popped, with the rows since as its count, where the next does
not share it.  (The stack is held as arrays here: how many words each suffix shares with the one before it says all there is to
push and pop.)  The counts of a phrase's parts are joined to it afterwards.

How suffixes travel.  A first pass counts the words of each language.  The DICTIONARY most frequent ones that occur MIN_COUNT
times get numbers, which go to all tasks: their number and length are bounded.  If all words that occur MIN_COUNT times have
one, a suffix ends before any other word, for no candidate holds such a word; else other words are carried spelled out.  A
task's suffixes with the same first word are one row with an array of numbers.

Skew.  A first word with more than GROUP suffixes is dealt by its second word to as many tasks as that takes, and a pair of
words with more than PAIR by its third.  A task sorts some CHUNK suffixes at a time, whole groups of them where a group has no
more than PAIR.  Where a phrase's rows may lie in several groups or chunks, its partial counts all go on, and are added up at
the end; any other phrase is complete where it is counted, so only those that occur MIN_COUNT times go on.  Which it is decides
the work, never the result.

Defined results: a null text has no words; a null language is ``und``; rows that repeat are counted as often as they come; an
empty table gives an empty result; columns other than text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import in_batches, stored
from ._text import Texts, Words, buffers, release, span_hashes, steps

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Words with a number at most, and their bytes at most.
DICTIONARY, WORD_BYTES = 1 << 17, 64
#: Suffixes of a first word in a group, and of a pair of words; both are more where that would make more than HOT of them.
#: Suffixes that are sorted at a time, and groups that a pair is dealt to.
GROUP, PAIR, HOT, CHUNK, SPREAD = 1 << 17, 1 << 20, 50_000, 1 << 18, 64
STEP_BYTES = 4 << 20
#: Languages whose totals are broadcast.
LANGUAGES = 10_000

_IN_WORD = np.ones(256, dtype=bool)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORD[[0x20, 0x09]] = False
_IN_WORD[_BREAK] = False


class Step:
    """Words of some texts: which distinct word each is, which language, and whether the next one stands in the same piece."""

    def __init__(self, texts: Texts, langs: pa.Array):
        low = texts.lowered()
        words = Words(low, _IN_WORD)
        self.n = len(words)
        owner = words.owner()
        known = langs.dictionary_encode()
        self.langs = known.dictionary.to_pylist()
        self.lang = known.indices.to_numpy()[owner].astype(np.int64)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[low.data])])
        self.follows = np.zeros(self.n, dtype=bool)
        if self.n:
            same = (owner[1:] == owner[:-1]) & (breaks[words.start[1:]] == breaks[words.start[:-1]])
            self.follows[:-1] = same
        places = np.concatenate([[0], np.cumsum(words.end - words.start)])
        body = low.data[_IN_WORD[low.data]]
        spelled = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        self.word = spelled.indices.to_numpy().astype(np.int64)
        self.words = [w.decode() for w in spelled.dictionary.to_pylist()]
        data, offsets = buffers(spelled.dictionary)
        #: The same number for a word in every task.
        self.hashes = span_hashes(data, offsets[:-1], offsets[1:])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[Step]:
    for batch in batches:
        for a, b, texts in steps(batch.column("text"), STEP_BYTES):
            got = Step(texts, batch.column("lang").slice(a, b - a))
            if got.n:
                yield got


def _rows(docs: DataFrame) -> DataFrame:
    return in_batches(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, second, n): how often each word occurs (second is null), and of pairs of words those that have more than one
    in HOT of the words of a step, counted where that is so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _steps(batches):
            d = len(s.words)
            seen, n = np.unique(s.lang * d + s.word, return_counts=True)
            at = np.flatnonzero(s.follows)
            key = (s.lang[at] * d + s.word[at]) * d + s.word[at + 1]
            pairs, m = np.unique(key, return_counts=True)
            often = m > max(s.n / HOT, 1)
            pairs, m = pairs[often], m[often]
            langs = np.concatenate([seen // d, pairs // d // d])
            first = np.concatenate([seen % d, pairs // d % d])
            second = [None] * len(seen) + [s.words[i] for i in (pairs % d).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(s.langs, pa.string()).take(pa.array(langs)), pa.array(s.words, pa.string()).take(pa.array(first)), pa.array(second, pa.string()), pa.array(np.concatenate([n, m]))], names=["lang", "word", "second", "n"])
        release()

    return _rows(docs).mapInArrow(run, "lang string, word string, second string, n bigint").groupBy("lang", "word", "second").agg(F.sum("n").alias("n"))


class Plan:
    """What every task needs to know of the corpus; its size is bounded by DICTIONARY and HOT."""

    def __init__(self, counts: DataFrame, min_count: int):
        words = counts.filter("second IS NULL")
        often = words.filter(F.col("n") >= min_count)
        short = often.filter(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
        # Equal words of several languages share a number.
        self.words = [r.word for r in short.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()]
        self.complete = len(self.words) < DICTIONARY and often.filter(F.octet_length("word") > WORD_BYTES).isEmpty()
        total = words.agg(F.sum("n")).first()[0] or 0
        #: A language's words with more than GROUP suffixes, of which there are fewer than all words over GROUP, and at most HOT.
        bar, pair_bar = max(GROUP, total // HOT), max(PAIR, total // HOT)
        self.split = {(r.lang, r.word): -(-r.n // bar) for r in words.filter(F.col("n") > bar).collect()}
        hot = counts.filter(F.col("second").isNotNull() & (F.col("n") > pair_bar))
        self.hot = {(r.lang, r.word, r.second) for r in hot.orderBy(F.desc("n")).limit(HOT).collect()}


_NONE = -1


def _suffixes(docs: DataFrame, plan: Plan, max_words: int) -> DataFrame:
    """(lang, first, salt, whole, rest, spelled): suffixes of a step with the same first word.

    rest has max_words - 1 numbers for each suffix: a word's number, -1 after the end, or DICTIONARY and more for a word in
    spelled.  A phrase of `whole` words and more has all its suffixes in the rows of one salt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(plan.words)}
        for s in _steps(batches):
            # of each distinct word its number; _NONE where no candidate can hold it; else DICTIONARY + its place in the step
            of = np.array([number.get(w, _NONE if plan.complete else DICTIONARY + i) for i, w in enumerate(s.words)], np.int64)
            code = of[s.word]
            rest = np.full((s.n, max_words - 1), _NONE, np.int64)
            live = np.flatnonzero(s.follows & (code != _NONE))
            starts = live = live[code[live + 1] != _NONE]
            for k in range(max_words - 1):
                rest[live, k] = code[live + k + 1]
                live = live[s.follows[live + k + 1]] if len(live) else live
                nxt = live + k + 2
                live = live[code[nxt] != _NONE] if len(live) else live
            if not len(starts):
                continue
            d = len(s.words)
            lang, first, second = s.lang[starts], s.word[starts], s.word[starts + 1]
            salt, whole, place = np.zeros(len(starts), np.int64), np.full(len(starts), 2), _places(s)
            fan = np.zeros(len(s.langs) * d, np.int64)
            for (name, w), k in plan.split.items():
                if name in s.langs and w in place:
                    fan[s.langs.index(name) * d + place[w]] = k
            k = fan[lang * d + first]
            at = np.flatnonzero(k)
            salt[at] = 1 + (s.hashes[second[at]] % k[at].astype(np.uint64)).astype(np.int64)
            hot = [(s.langs.index(name) * d + place[a]) * d + place[b] for name, a, b in plan.hot if name in s.langs and a in place and b in place]
            at = np.flatnonzero(np.isin((lang * d + first) * d + second, hot))
            third = np.where(rest[starts[at], 1] == _NONE, 0, s.hashes[s.word[np.minimum(starts[at] + 2, s.n - 1)]] % np.uint64(SPREAD)).astype(np.int64)
            salt[at], whole[at] = -1 - third, 3
            order = np.lexsort((salt, first, lang))
            lang, first, salt, whole, body = lang[order], first[order], salt[order], whole[order], rest[starts[order]]
            edge = np.concatenate([[True], (lang[1:] != lang[:-1]) | (first[1:] != first[:-1]) | (salt[1:] != salt[:-1])])
            begin = np.flatnonzero(edge)
            size = np.diff(np.append(begin, len(order)))
            spelled = [[] for _ in begin]
            if not plan.complete:
                group = np.cumsum(edge) - 1
                far = np.argwhere(body >= DICTIONARY)
                for (r, c) in far.tolist():
                    mine = spelled[group[r]]
                    mine.append(s.words[body[r, c] - DICTIONARY])
                    body[r, c] = DICTIONARY + len(mine) - 1
            flat = np.ascontiguousarray(body.astype("<i4")).reshape(-1)
            at = np.concatenate([[0], np.cumsum(size * (max_words - 1) * 4)]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())])
            columns = [pa.array(s.langs, pa.string()).take(pa.array(lang[begin])), pa.array(s.words, pa.string()).take(pa.array(first[begin])), pa.array(salt[begin].astype(np.int32)), pa.array(whole[begin].astype(np.int32)), blobs, pa.array(spelled, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "first", "salt", "whole", "rest", "spelled"])
        release()

    return _rows(docs).mapInArrow(run, "lang string, first string, salt int, whole int, rest binary, spelled array<string>")


def _places(s: Step) -> dict[str, int]:
    return dict(zip(s.words, range(len(s.words))))


def prefix_counts(keys: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words, count) of every prefix of two words and more: a row that has it, how many words it has, how many rows do.

    keys number the first words.  Sorted in reverse, row i shares[i] words with the row before; a prefix of d words is pushed at
    rows that share fewer than d, and popped at the next such row.
    """
    order = np.lexsort((*(rest[:, k] for k in range(rest.shape[1] - 1, -1, -1)), keys))[::-1]
    keys, rest = keys[order], rest[order]
    shares = np.zeros(len(keys), np.int8)
    same = keys[1:] == keys[:-1]
    shares[1:][same] = 1
    for k in range(rest.shape[1]):
        same &= rest[1:, k] == rest[:-1, k]
        shares[1:] += same
    out = []
    for d in range(2, rest.shape[1] + 2):
        pushed = np.flatnonzero(shares < d)
        # what is popped at the next row that shares fewer words
        count = np.diff(np.append(pushed, len(keys)))
        real = rest[pushed, d - 2] != _NONE
        out.append((order[pushed[real]], np.full(int(real.sum()), d), count[real]))
    return tuple(np.concatenate(c) for c in zip(*out))


def phrase_counts(docs: DataFrame, plan: Plan, max_words: int, min_count: int) -> DataFrame:
    """(lang, phrase, words, n) of the phrases of two words and more that occur min_count times."""
    schema = "lang string, phrase string, words int, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, own, broken = 0, 0, None  # suffixes held, those of the last group, and a group whose rows a chunk has left

        def flush(cut: bool) -> Iterator[pa.RecordBatch]:
            """Count what is held; cut says that more rows of the last group follow."""
            nonlocal held, size, own, broken
            if not held:
                return
            groups = [row[:3] for row in held]
            number: dict[tuple, int] = {}
            group = np.array([number.setdefault(g, len(number)) for g in groups], np.int32)
            bodies = [np.frombuffer(row[4], "<i4").reshape(-1, max_words - 1) for row in held]
            far: dict[str, int] = {}
            for i, row in enumerate(held):
                if row[5]:
                    to = np.array([far.setdefault(w, len(far)) for w in row[5]], np.int32)
                    bodies[i] = np.where(bodies[i] >= DICTIONARY, DICTIONARY + to[np.maximum(bodies[i] - DICTIONARY, 0) % len(to)], bodies[i])
            keys, rest = np.repeat(group, [len(b) for b in bodies]), np.concatenate(bodies)
            del bodies
            row, words, count = prefix_counts(keys, rest)
            # Phrases of so many words are counted here for good; none are in a group that other chunks have rows of.
            whole = np.array([2] * len(number))
            whole[group] = [r[3] for r in held]
            for g in (broken, groups[-1] if cut else None):
                if g in number:
                    whole[number[g]] = max_words + 1
            broken = groups[-1] if cut else None
            keep = (count >= min_count) | (words < whole[keys[row]])
            row, words, count = row[keep], words[keep], count[keep]
            names, spelled_out = list(number), list(far)
            said = lambda c: plan.words[c] if c < DICTIONARY else spelled_out[c - DICTIONARY]
            phrases = [" ".join([names[g][1], *map(said, codes[: w - 1])]) for g, w, codes in zip(keys[row].tolist(), words.tolist(), rest[row].tolist())]
            langs = [names[g][0] for g in keys[row].tolist()]
            held, size, own = [], 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(words.astype(np.int32)), pa.array(count.astype(np.int64))], names=["lang", "phrase", "words", "n"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "first", "salt", "whole", "rest", "spelled"))):
                goes_on = bool(held) and row[:3] == held[-1][:3]
                if size >= CHUNK and not goes_on or own >= PAIR:
                    yield from flush(goes_on)
                    goes_on = False
                held.append(row)
                many = len(row[4]) // (4 * (max_words - 1))
                size, own = size + many, own * goes_on + many
        yield from flush(False)
        release()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _suffixes(docs, plan, max_words).repartition(n, "lang", "first", "salt").sortWithinPartitions("lang", "first", "salt")
    partial = dealt.mapInArrow(run, schema)
    return partial.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase at its lowest-scoring cut."""
    known = phrases.select("lang", "phrase", F.col("n").alias("f")).unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = F.split("phrase", " ")
    part = lambda low, size: F.array_join(F.slice(parts, low, size), " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # One row for each language: sent to all tasks where they are few, as they should be.
    totals = F.broadcast(totals) if totals.count() <= LANGUAGES else totals
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    score = floor_ratio(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def floor_ratio(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = (F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(15,0)")).cast("decimal(19,0)") * wide(n)
    under = wide(l) * wide(r)
    return F.call_function("div", over, under).cast("bigint")


def _outlived(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer phrase with as high a count holds.

    A phrase between two of equal counts has the same count, so it is enough to look one word further.
    """
    ends = phrases.filter("words > 2").withColumn("begin", F.explode(F.array(F.lit(1), F.lit(2))))
    short = F.array_join(F.slice(F.split("phrase", " "), F.col("begin"), F.col("words") - 1), " ")
    within = ends.select("lang", short.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return phrases.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).drop("longer")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    counts = stored(word_counts(docs), "words")
    plan = Plan(counts, min_count)
    phrases = stored(phrase_counts(docs, plan, max_words, min_count), "phrases")
    words = counts.filter("second IS NULL").select("lang", "word", "n")
    scores = _scored(phrases, words)
    kept = _outlived(phrases).select("lang", "phrase").join(scores, ["lang", "phrase"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each of many parts of a language, then the best of these.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = kept.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
