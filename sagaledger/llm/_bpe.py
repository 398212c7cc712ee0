"""Token ids of Arrow string columns: texts are cut into units, and every unit that a worker has not met is encoded once.

A byte-level vocabulary of the tokenizers library cuts a text by a fixed pattern: contractions, letters, digits and other
signs, each with at most one space before it, and white space.  The cuts of that pattern are found here by array operations
on the UTF-8 bytes, equal units share one encoding, and only units that are new go to the library's model.  A word with an
apostrophe or with letters from beyond the Latin blocks is one unit that the library cuts itself.  A text that holds an added
token, such as <|endoftext|>, or white space of a rare kind goes to the library whole.  So the ids are those of
``encode(text, add_special_tokens=False)`` of the tokenizer as its file states it.

A worker's cache of units is bounded by bytes.  Units met after it is full are forgotten with their step.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import in_batches
from ._text import Texts, buffers, ranges, release, steps

#: Bytes of a worker's cache of units, about; and bytes of text in a step.
CACHE_BYTES = 32 << 20
STEP_BYTES = 2 << 20
#: What a unit in the cache costs beside its own bytes: two objects, a place in a table, the pool's offsets.
_UNIT_COST = 180


class UnitEncoder:
    """Encodes columns by units.  Subclasses say where a text is cut, and what a unit's and a whole text's ids are."""

    dtype: np.dtype
    cache_bytes: int | None = None  # CACHE_BYTES if none

    def odd(self, texts: Texts) -> np.ndarray:
        """For each text, whether it must be encoded whole."""
        return np.zeros(len(texts), dtype=bool)

    def cut(self, texts: Texts) -> np.ndarray:
        """First byte of every unit, in order."""
        raise NotImplementedError

    def units(self, raw: list[bytes]) -> list[list[int]]:
        """The ids of units."""
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def prepared(self, column: pa.Array) -> Texts:
        return Texts(*buffers(column))

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, dtype=self.dtype)
        self.begin = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = self.filled = self.cost = 0

    def _add_all(self, lists: list[list[int]]) -> int:
        """Put lists of ids into the pool; the first one's slot."""
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        total, n = int(counts.sum()), len(lists)
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.used + n > len(self.begin):
            self.begin, self.count = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.pool[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(lists), self.dtype, total)
        slot = self.used
        self.begin[slot : slot + n] = self.filled + np.cumsum(counts) - counts
        self.count[slot : slot + n] = counts
        self.filled += total
        self.used += n
        return slot

    def _known(self, units: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The slots of distinct units, and the units that are new."""
        found = list(map(self.slots.get, units))
        new = [u for u, s in zip(units, found) if s is None]
        slot = self._add_all(self.units(new))
        self.slots.update(zip(new, range(slot, slot + len(new))))
        out = np.array([-1 if s is None else s for s in found], dtype=np.int64)
        out[out < 0] = np.arange(slot, slot + len(new))
        return out, new

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's); end_id is put after each text.  A null is an empty text."""
        texts = self.prepared(column)
        odd = self.odd(texts)
        if odd.any():
            lengths = np.where(odd, 0, np.diff(texts.offsets))
            texts = Texts(texts.data[np.repeat(~odd, np.diff(texts.offsets))], np.concatenate([[0], np.cumsum(lengths)]))
        start = self.cut(texts)
        first = np.searchsorted(start, texts.offsets)
        mark = self.used, self.filled
        slots, new = np.zeros(0, np.int64), []
        if len(start):
            places = np.append(start, len(texts.data)).astype(np.int64)
            units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(texts.data))]).dictionary_encode()
            known, new = self._known(units.dictionary.to_pylist())
            slots = known[units.indices.to_numpy()]
            del units
        cost = sum(map(len, new)) + _UNIT_COST * len(new)
        if self.cost + cost <= (self.cache_bytes or CACHE_BYTES):
            self.cost += cost
            mark, new = (self.used, self.filled), []
        count, begin = self.count[slots], self.begin[slots]
        if end_id is not None or odd.any():
            # one more place after each text's units: the ids of a text that was encoded whole, and the end id
            n, end = len(texts), [] if end_id is None else [end_id]
            extra = np.full(n, self._add_all([end]))
            at = np.flatnonzero(odd)
            extra[at] = self._add_all([self.whole(t) + end for t in column.take(pa.array(at)).to_pylist()]) + np.arange(len(at))
            inner = np.ones(len(count) + n, dtype=bool)
            inner[first[1:] + np.arange(n)] = False
            all_count, all_begin = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
            all_count[inner], all_begin[inner] = count, begin
            all_count[~inner], all_begin[~inner] = self.count[extra], self.begin[extra]
            count, begin, first = all_count, all_begin, first + np.arange(n + 1)
        at = np.concatenate([[0], np.cumsum(count)])[first]
        ids = self.pool[ranges(begin, count)]
        # What was added beyond the cache's size is forgotten, so that the frequent units, which came early, stay.
        self.used, self.filled = mark
        for u in new:
            del self.slots[u]
        return ids, at


# Classes of characters: letter, digit, other sign, space, other white space; a character whose word the library cuts; one
# whose text the library encodes whole.
LETTER, DIGIT, SIGN, SPACE, WHITE, WORD, TEXT = range(7)
#: White space beyond Latin, as UTF-8 (fixed values).
_FAR_SPACES = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def _ascii_class(byte: int) -> int:
    c = chr(byte)
    if c == " ":
        return SPACE
    if c in "\t\n\v\f\r":
        return WHITE
    if 0x1C <= byte < 0x20:
        return TEXT
    return LETTER if c.isalpha() else DIGIT if c.isdigit() else WORD if c == "'" else SIGN


def _latin_class(point: int) -> int:
    """Of U+0080 to U+00FF: letters, digits and other signs as Unicode has them; the two of them that are white space."""
    c = chr(point)
    return TEXT if c in "\x85\xa0" else LETTER if c.isalpha() else DIGIT if c.isnumeric() else SIGN


# Of a byte: its class if it is ASCII; the leading bytes C4 to C8 begin letters only; all that stands further is WORD.
_OF_BYTE = np.array([_ascii_class(b) for b in range(0x80)] + [LETTER if 0xC4 <= b < 0xC9 else WORD for b in range(0x80, 0x100)], dtype=np.uint8)
_OF_SECOND = np.array([[_latin_class((lead << 6 | b & 0x3F) & 0xFF) for b in range(0x100)] for lead in (2, 3)], dtype=np.uint8)


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of every byte's character."""
    kind = _OF_BYTE[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first, second = data[lead], data[lead + 1]
        latin = first < 0xC4
        kind[lead[latin]] = _OF_SECOND[first[latin] - 0xC2, second[latin]]
        two = lead[first < 0xC9]
        kind[two + 1] = kind[two]
        three = lead[first >= 0xE0]
        if len(three):
            point = data[three].astype(np.int64) << 16 | data[three + 1].astype(np.int64) << 8 | data[three + 2]
            kind[three[np.isin(point, _FAR_SPACES)]] = TEXT
    return kind


class Encoder(UnitEncoder):
    """A byte-level BPE of the tokenizers library with its usual pattern of cuts."""

    def __init__(self, path: str, plain: bool = False):
        """With plain, the strings of special tokens in a text are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        # How a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on, in order.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = np.arange(256, dtype="<u2")
        self.letters[hidden] = 0x100 + np.arange(len(hidden))
        self.plain = bytes(b for b in range(256) if b < 0xC9 and b != 0x27)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        byte_of = {chr(c): b for b, c in enumerate(self.letters.tolist())}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        #: The bytes that each id stands for, and how many they are.
        self.names = [bytes(map(byte_of.__getitem__, n)) if byte_of.keys() >= set(n) else n.encode() for n in names]
        self.sizes = np.array([len(n) for n in self.names], np.int32)
        self._clear()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def units(self, raw: list[bytes]) -> list[list[int]]:
        # FF is no byte of any text, so it can stand between units while all of them are rewritten at once.
        shown = self.letters[np.frombuffer(b"\xff".join(raw), np.uint8)].tobytes().decode("utf-16-le").split("\xff")
        tokenize, plain = self.tokenizer.model.tokenize, self.plain
        # An apostrophe or a letter from afar: the library cuts.
        return [self.whole(u.decode()) if u.translate(None, plain) else [t.id for t in tokenize(s)] for u, s in zip(raw, shown)] if raw else []

    def prepared(self, column: pa.Array) -> Texts:
        self.marked = np.zeros(len(column), dtype=bool)
        for token in self.added:
            self.marked |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        return super().prepared(column)

    def odd(self, texts: Texts) -> np.ndarray:
        out = self.marked
        rare = np.flatnonzero(kinds(texts.data) == TEXT)
        out[np.searchsorted(texts.offsets, rare, side="right") - 1] = True
        return out

    def cut(self, texts: Texts) -> np.ndarray:
        data, offsets = texts.data, texts.offsets
        if not len(data):
            return np.zeros(0, np.int64)
        kind = kinds(data)
        white = (kind == SPACE) | (kind == WHITE)
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[heads] = TEXT
        ahead = np.zeros(len(data), dtype=bool)  # whether a sign, letter or digit follows in the same text
        ahead[:-1] = ~white[1:]
        ahead[ends] = False
        after_white = (before == SPACE) | (before == WHITE)
        # A run of white space gives its last space or line end to what follows; a single space belongs to the word.
        begin = np.where(white, ~after_white | ahead, (kind != before) & (before != SPACE))
        far = kind == WORD
        if far.any():
            word = ~white & (after_white | (before == TEXT))
            number = np.cumsum(word)
            has = np.zeros(int(number[-1]) + 1, dtype=bool)
            has[number[far]] = True
            begin &= white | word | ~has[number]
        begin[heads] = True
        return np.flatnonzero(begin)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]


def plain_encoder(path: str) -> Encoder:
    """An encoder that takes the strings of special tokens as ordinary text."""
    return encoder(path, True)


STAGED = "part int, first bigint, doc_id bigint, n_tokens bigint, ids binary"


def staged_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(part, first, doc_id, n_tokens, ids): every row's ids, and how many ids its partition has before it.

    part numbers the partitions of docs.  Store the result before it is used twice: then the numbers stand, whatever task
    is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, first = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, _ in steps(batch.column("text"), STEP_BYTES):
                ids, at = made.encode(batch.column("text").slice(a, b - a), end_id)
                n = b - a
                width = ids.dtype.itemsize
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(first + at[:-1]), batch.column("doc_id").slice(a, n), pa.array(np.diff(at)), blobs], names=["part", "first", "doc_id", "n_tokens", "ids"])
                first += int(at[-1])
        release()

    rows = in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, STAGED)


def part_bases(rows: DataFrame, size: str) -> np.ndarray:
    """Ids before each part, from the parts' totals: one number for each partition that was written."""
    got = rows.groupBy("part").agg(F.sum(size).alias("total")).toArrow()
    parts, totals = got["part"].to_numpy(), got["total"].to_numpy()
    out = np.zeros((int(parts.max()) if len(parts) else 0) + 2, dtype=np.int64)
    out[parts + 1] = totals
    return np.cumsum(out)
